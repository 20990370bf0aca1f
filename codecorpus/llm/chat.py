"""Chat formatting: records of several layouts become turns, turns become one marked text.

A record is JSON.  The paths of all its fields, hashed, are the fingerprint of its schema; a table
of declarative mappings, keyed by fingerprint, says where the turns are.  Everything is column
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import computed

TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
#: Bytes of JSON from which texts are read outside the variant, which holds no string of more than
#: 20,000,000 characters and 128 MiB together.
LONG_RECORD = 10_000_000
_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths`` are all field paths of the layout; ``[]`` stands for the elements of an array.
    Either ``messages`` names an array of objects with the fields ``role`` and ``text``, or
    ``fields`` lists (role, path) pairs in the order of the turns; a field that is null or missing
    gives no turn unless it is listed in ``required``.  ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


SPEAKERS = (("human", "user"), ("gpt", "assistant"))
#: The layouts that are known; callers may pass their own.
MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "messages"),
    Mapping("prompt_messages", ("prompt", "prompt[].content", "prompt[].role"), "prompt"),
    Mapping(
        "conversations",
        ("conversations", "conversations[].from", "conversations[].value"),
        "conversations", "from", "value", roles=SPEAKERS,
    ),
    Mapping("turns", ("turns", "turns[].speaker", "turns[].text"), "turns", "speaker", "text"),
    Mapping(
        "prompt_response", ("prompt", "response"),
        fields=(("user", "prompt"), ("assistant", "response")), required=("prompt", "response"),
    ),
    Mapping(
        "prompt_completion", ("completion", "prompt"),
        fields=(("user", "prompt"), ("assistant", "completion")),
        required=("prompt", "completion"),
    ),
    Mapping(
        "instruction_output", ("instruction", "output"),
        fields=(("user", "instruction"), ("assistant", "output")),
        required=("instruction", "output"),
    ),
    Mapping(
        "instruction_input_output", ("input", "instruction", "output"),
        fields=(("system", "instruction"), ("user", "input"), ("assistant", "output")),
        required=("input", "output"),
    ),
)


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.sort_array(F.array_distinct(paths)), "\n"))


def field_paths(value: Column) -> Column:
    """Field paths of a variant: fields, fields of objects in them and of objects in their arrays.

    What is nested below that ends its path with its whole schema, so layouts that differ at any
    depth differ in their paths.  An empty array gives the path ``name[]``, an array of anything but
    objects that path with its schema.  A null record has no paths.
    """
    none = F.array().cast("array<string>")
    top = F.try_variant_get(value, "$", "map<string,variant>")
    own = F.coalesce(F.map_keys(top), none)

    def named(fields: Column) -> Column:
        def one(entry: Column) -> Column:
            schema = F.schema_of_variant(entry["value"])
            deep = schema.startswith("OBJECT") | schema.startswith("ARRAY")
            return F.concat(entry["key"], F.when(deep, F.concat(F.lit(":"), schema)).otherwise(""))

        return F.transform(F.map_entries(fields), one)

    def below(key: Column, child: Column) -> Column:
        fields = named(F.try_variant_get(child, "$", "map<string,variant>"))
        items = F.try_variant_get(child, "$", "array<map<string,variant>>")
        inner = F.array_distinct(F.flatten(F.transform(items, named)))
        dotted = F.transform(fields, lambda name: F.concat(key, F.lit("."), name))
        listed = F.transform(inner, lambda name: F.concat(key, F.lit("[]."), name))
        schema = F.schema_of_variant(child)
        odd = items.isNull() | F.exists(items, lambda item: item.isNull())
        others = F.when(odd, F.array(F.concat(key, F.lit("[]:"), schema)))
        others = others.when(F.size(items) == 0, F.array(F.concat(key, F.lit("[]"))))
        others = F.when(schema.startswith("ARRAY"), others)
        return F.concat(F.coalesce(dotted, none), F.coalesce(listed, none), F.coalesce(others, none))

    nested = F.flatten(F.map_values(F.transform_values(top, below)))
    return F.concat(own, F.coalesce(nested, none))


def without_texts(record: Column) -> Column:
    """The JSON with every string that is a value made empty, so that only its fields are left."""
    pattern = f'(?s)("{_STRING}"\\s*+:)|("){_STRING}(")'
    return F.regexp_replace(record, pattern, "$1$2$3")


def _field(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$['{path}']", kind)


def _long_field(record: Column, path: str, kind: str) -> Column:
    """A field of a JSON string of any length; the query fails if the record cannot be read whole.

    Strings are the same as those of ``_field``; numbers are as they are written.
    """
    options = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "_bad"}
    read = F.from_json(record, f"`{path}` {kind}, _bad string", options)
    error = F.raise_error(F.lit("a long record is not JSON that can be read whole"))
    return F.when(read["_bad"].isNotNull(), error).otherwise(read[path])


def _turns(value: Column, mapping: Mapping, field=_field) -> Column:
    if mapping.messages is not None:
        items = field(value, mapping.messages, "array<map<string,string>>")

        def one(item: Column) -> Column:
            role = F.coalesce(F.try_element_at(item, F.lit(mapping.role)), F.lit(""))
            for old, new in mapping.roles:
                role = F.when(role == old, F.lit(new)).otherwise(role)
            text = F.coalesce(F.try_element_at(item, F.lit(mapping.text)), F.lit(""))
            return F.struct(role.alias("role"), text.alias("text"))

        return F.transform(items, one)
    found = []
    for role, path in mapping.fields:
        text = field(value, path, "string")
        present = F.lit(True) if path in mapping.required else text.isNotNull()
        turn = F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        found.append(F.when(present, turn))
    return F.filter(F.array(*found), lambda turn: turn.isNotNull())


def canonical_turns(
    records: DataFrame,
    record: str = "record",
    mappings: tuple[Mapping, ...] = MAPPINGS,
) -> DataFrame:
    """``records`` with layout, schema_hash and turns (array of role and text).

    The hash of the record's field paths picks the mapping.  A record that is null, no JSON, or of
    an unknown layout has null for layout and turns, so that callers can count and repair it.  An
    empty array of messages is a conversation of no turns.  A null role or text becomes empty.  The new columns replace columns of the same name; an empty
    table gives an empty table.
    """
    names = ["layout", "schema_hash", "turns"]
    rest = records.select(*[name for name in records.columns if name not in names])
    is_long = F.octet_length(record) > LONG_RECORD
    fields = F.when(is_long, without_texts(F.col(record))).otherwise(F.col(record))
    rows = computed(rest, _value=F.try_parse_json(fields))
    rows = computed(rows, schema_hash=path_hash(field_paths(F.col("_value"))))
    layout = F.lit(None).cast("string")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for mapping in mappings:
        is_it = F.col("schema_hash") == path_hash(F.array(*[F.lit(p) for p in mapping.paths]))
        if mapping.messages is not None:
            empty = F.array(F.lit(mapping.messages), F.lit(f"{mapping.messages}[]"))
            is_it |= F.col("schema_hash") == path_hash(empty)
        layout = F.when(is_it, F.lit(mapping.name)).otherwise(layout)
        whole = _turns(F.col(record), mapping, _long_field)
        turns = (
            F.when(is_it & is_long, whole).when(is_it, _turns(F.col("_value"), mapping)).otherwise(turns)
        )
    return computed(rows, layout=layout, turns=turns).drop("_value")


def sure_turns(rows: DataFrame, record: str = "record") -> DataFrame:
    """``rows`` as they are; the query fails if a record that is not null has no turns."""
    error = F.raise_error(F.lit("a record gives no turns: no JSON, too long, or of an unknown layout"))
    lost = F.col("turns").isNull() & F.col(record).isNotNull()
    return rows.withColumn("turns", F.when(lost, error).otherwise(F.col("turns")))


def escaped(text: Column) -> Column:
    """A text in which no control string can occur: ``<|`` gets a backslash inside."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame, key: str, turns: str = "turns") -> DataFrame:
    """One row per record: its turns as one text, and the mask of the loss.

    Columns: the key, ``formatted``, and ``loss_mask``: runs of (n_chars, loss) that together cover
    the text's code points in order.  Each turn has three runs, its head, its escaped text and its
    end mark; only the text of an assistant turn is under the loss.  Roles are URL-encoded and
    texts escaped, so every mark in the output is a real one and ``read_formatted`` gives back the
    turns.  A record without turns has an empty text and an empty mask; records with the same key
    are formatted alone, each in its own row.
    """
    pieces = F.transform(
        F.col(turns),
        lambda turn: F.struct(
            F.concat(F.lit(TURN_START), F.url_encode(turn["role"]), F.lit("\n")).alias("head"),
            escaped(turn["text"]).alias("body"),
            (turn["role"] == "assistant").alias("loss"),
        ),
    )
    none = F.array().cast("array<struct<head:string,body:string,loss:boolean>>")
    rows = computed(rows.select(key, turns), _pieces=F.coalesce(pieces, none)).drop(turns)

    def run(n_chars: Column, loss: Column) -> Column:
        return F.struct(n_chars.cast("int").alias("n_chars"), loss.alias("loss"))

    runs = F.flatten(
        F.transform(
            "_pieces",
            lambda p: F.array(
                run(F.length(p["head"]), F.lit(False)),
                run(F.length(p["body"]), p["loss"]),
                run(F.lit(len(TURN_END)), F.lit(False)),
            ),
        )
    )
    formatted = F.array_join(
        F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), ""
    )
    return computed(rows, formatted=formatted, loss_mask=runs).drop("_pieces")


def read_formatted(rows: DataFrame, key: str) -> DataFrame:
    """The turns of formatted texts: key, formatted, and turns (array of role, text, has_loss).

    The text is cut at its marks and laid beside the mask.  If the runs of the mask are not exactly
    the heads, texts and end marks that were found, the query fails: such a mask would train on
    the wrong characters.
    """
    cut = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda piece: piece != "")
    rows = computed(rows.select(key, "formatted", "loss_mask"), _cut=cut)
    end = F.lit(2**31 - 1)
    parsed = F.transform(
        F.transform(
            "_cut",
            lambda piece: F.struct(
                F.substring_index(piece, "\n", 1).alias("head"), piece.alias("piece")
            ),
        ),
        lambda p: F.struct(
            F.substring(p["head"], F.lit(len(TURN_START) + 1), end).alias("role"),
            (F.length(p["head"]) + 1).alias("n_head"),
            F.substring(p["piece"], F.length(p["head"]) + 2, end).alias("body"),
        ),
    )
    rows = computed(rows, _parsed=parsed).drop("_cut")
    found = F.flatten(
        F.transform("_parsed", lambda p: F.array(p["n_head"], F.length(p["body"]), F.lit(len(TURN_END))))
    )
    same = found == F.transform("loss_mask", lambda run: run["n_chars"])
    mask = F.when(same, F.col("loss_mask")).otherwise(
        F.raise_error(F.lit("the loss mask does not fit the turns of the text"))
    )
    rows = computed(rows, _mask=mask)
    turns = F.transform(
        "_parsed",
        lambda p, i: F.struct(
            F.url_decode(p["role"]).alias("role"),
            unescaped(p["body"]).alias("text"),
            F.get(F.col("_mask"), i * 3 + 1)["loss"].alias("has_loss"),
        ),
    )
    return computed(rows, turns=turns).select(key, "formatted", "turns")


def turns_of_rows(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows of one turn each as one JSON record per key, in order of turn.

    Ties of the turn number go by role, then by text; nulls come first.  A record of exactly one
    user and one assistant turn is written in the layout of prompt and response, any other in that
    of messages, so both ways of the mapping are in use.
    """
    item = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    messages = F.transform(
        "_items", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    )
    first, second = F.get(F.col("_items"), F.lit(0)), F.get(F.col("_items"), F.lit(1))
    is_pair = (
        (F.size("_items") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    )
    pair = F.struct(first["content"].alias("prompt"), second["content"].alias("response"))
    record = F.when(is_pair, F.to_json(pair)).otherwise(
        F.to_json(F.struct(messages.alias("messages")))
    )
    return grouped.select(F.col(key), record.alias("record"))
