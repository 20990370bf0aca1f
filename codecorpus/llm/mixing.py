"""Mixing sources to target weights by pivotal dependent rounding.

The target of a source, divided by its size, is how often each of its documents should be taken.
The whole part is taken as it is; the fractions are rounded together: two documents exchange
probability mass, in words, until one of the fractions is 0 or 1.  The words of the pair stay the
same, so the source as a whole ends within one document of its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.frames import numbered, place, restored
from codecorpus.llm.host_lines import WORD, text_of
from codecorpus.session import broadcast_if_small, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
#: Documents rounded in one group, and residuals combined in one node of the reduction tree.
GROUP = 2000
FAN_IN = 64
#: A fraction this near to 0 or 1 counts as whole.
NEAR = 1e-9


def ranked_sources(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """_source, source_size, _docs, _weight: one row per source (null is one, and comes last).

    Weights repeat over the sources in order of code points.  The order is global without a global
    task: sources are dealt by ranges and numbered inside each range; only the number of sources of
    each range goes to the driver.
    """
    sources = rows.groupBy("_source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")
    )
    order = F.col("_source").asc_nulls_last()
    ranged = stored(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = {row["_part"]: row["count"] for row in ranged.groupBy("_part").count().collect()}
    before, offset = 0, F.lit(0)
    for part in sorted(sizes):
        offset = F.when(F.col("_part") == part, F.lit(before)).otherwise(offset)
        before += sizes[part]
    place = offset + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranged.withColumn(
        "_weight", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ).drop("_part")


def source_targets(
    rows: DataFrame, share: float, weights: tuple[float, ...], max_copies: int
) -> DataFrame:
    """``ranked_sources`` with target: weights share out ``share`` of all words.

    Targets stop at ``max_copies`` times the source's size, and what is above goes to the other
    sources by weight until none is above.  Each round is one aggregate of two numbers; the set of
    stopped sources only grows, so it ends.
    """
    sources = stored(ranked_sources(rows, weights))
    cap = F.col("source_size") * F.lit(float(max_copies))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("_weight") >= cap
        row = sources.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("words"),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == stopped or not row["weight"]:
            break
        stopped = row["n"]
        level = max(0.0, total - row["words"]) / row["weight"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("_weight")))


def pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounded fractions and the place of the one that is left over (-1 if none is).

    The one that is left carries on to the next document.  The direction of each exchange is drawn
    so that the expected fraction of both stays what it was.
    """
    part = part.copy()
    draws = rng.random(len(part))
    held = -1
    for i in range(len(part)):
        if part[i] <= NEAR or part[i] >= 1 - NEAR:
            part[i] = round(part[i])
            continue
        if held < 0:
            held = i
            continue
        s, t = size[held], size[i]
        gain = min((1 - part[held]) * s, part[i] * t)
        loss = min(part[held] * s, (1 - part[i]) * t)
        moved = gain if draws[i] * (gain + loss) < loss else -loss
        part[held] += moved / s
        part[i] -= moved / t
        rest = -1
        for k in (held, i):
            if NEAR < part[k] < 1 - NEAR:
                rest = k
            else:
                part[k] = round(part[k])
        held = rest
    return part, held


def repair(size: np.ndarray, fraction: np.ndarray, part: np.ndarray, excess: float) -> None:
    """Takes ``excess`` words out of the rounded fractions, or adds them if it is negative, in place.

    Documents change sides, longest first, as long as that brings the sum nearer.
    """
    for i in np.argsort(-size, kind="stable"):
        if size[i] <= 0 or not NEAR < fraction[i] < 1 - NEAR:
            continue
        if excess >= size[i] and part[i] == 1:
            part[i], excess = 0.0, excess - size[i]
        elif -excess >= size[i] and part[i] == 0:
            part[i], excess = 1.0, excess + size[i]


def shares_of_groups(done: DataFrame, n_levels: int) -> DataFrame:
    """_of, _at, _share: the words that each group of documents has to give up (or take, below 0).

    ``done`` has _source, _leaf, size, _part, _fraction and _drawn, where ``_drawn`` is what the last
    draw of a source added.  The groups of a source hold so many words of documents that can change
    sides; going down the tree, each node deals its share to its children in order, as far as each
    can hold it.  A node has at most ``FAN_IN`` children, so no window holds more rows.
    """
    drawn = stored(done.where("_drawn <> 0").select(F.col("_source").alias("_of"), F.col("_drawn").alias("_share")))
    free = (F.col("_drawn") == 0) & (F.col("size") > 0) & F.col("_fraction").between(NEAR, 1 - NEAR)
    words = F.when(free, F.col("size")).otherwise(0)
    held = done.groupBy("_source", F.col("_leaf").alias("_at")).agg(
        F.sum(F.when(F.col("_part") == 1, words).otherwise(0)).alias("_down"),
        F.sum(F.when(F.col("_part") == 0, words).otherwise(0)).alias("_up"),
    )
    levels = [stored(held)]
    for _ in range(n_levels - 1):
        above = F.floor(F.col("_at") / F.lit(FAN_IN)).cast("long").alias("_at")
        levels.append(
            stored(levels[-1].groupBy("_source", above).agg(F.sum("_down").alias("_down"), F.sum("_up").alias("_up")))
        )
    shares = drawn.withColumn("_at", F.lit(0).cast("long"))
    for level in reversed(levels[:-1]):
        nodes = level.withColumn("_node", F.floor(F.col("_at") / F.lit(FAN_IN)).cast("long"))
        parents = broadcast_if_small(stored(shares.withColumnRenamed("_at", "_over")))
        found = nodes.join(
            parents, nodes["_source"].eqNullSafe(parents["_of"]) & (F.col("_node") == F.col("_over"))
        )
        room = F.when(F.col("_share") > 0, F.col("_down")).otherwise(F.col("_up"))
        before = Window.partitionBy("_of", "_node").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        left = F.abs("_share") - F.coalesce(F.sum("_room").over(before), F.lit(0))
        mine = F.signum("_share") * F.least(F.col("_room"), left)
        shares = (
            found.withColumn("_room", room).withColumn("_mine", F.when(left > 0, mine))
            .where("_mine <> 0").select("_of", "_at", F.col("_mine").alias("_share"))
        )
    return shares


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = SHARE,
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 7,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, _key.

    ``size`` is the number of words, ``copies`` how often the document is taken, ``taken`` copies
    times size.  ``_key`` is a digest of doc_id and text.  Documents are dealt into groups by that
    digest, rounded group by group, and the one fraction left in each group goes up a tree of fixed
    fan-in; its root is rounded by a draw.  The words which that draw adds or takes go back down the
    tree to the groups, where shorter documents make good for them.  Draws come from the seed and
    the digests, so reruns agree whatever the partitions are.  A null or empty text has size 0 and is never taken; a null
    source is a source of its own; rows that repeat doc_id and text are rounded one by one; an
    empty table gives an empty table.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("_source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"),
    )
    rows = stored(rows)
    targets = stored(source_targets(rows, share, weights, max_copies))
    small = broadcast_if_small(targets.withColumnRenamed("_source", "_of"))
    rows = rows.join(small, rows["_source"].eqNullSafe(small["_of"])).drop("_of", "_weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + NEAR)
    n_groups = F.ceil(F.col("_docs") / F.lit(GROUP))
    rows = rows.select(
        "doc_id", "_source", "size", "source_size", "target", "_key", "_docs",
        whole.cast("long").alias("_whole"),
        F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0).alias("_part"),
        F.pmod(F.xxhash64("_key", F.lit(seed)), n_groups).alias("_group"),
        F.lit(False).alias("_left"),
        F.lit(0.0).alias("_drawn"),
    )
    rows = rows.withColumns({"_leaf": F.col("_group"), "_fraction": F.col("_part")})
    schema = rows.schema

    def rounded(level: int, is_root: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(
                ["size", "_key"], ascending=[False, True], kind="stable", ignore_index=True
            )
            key = int(group["_key"].iloc[0]) & (2**63 - 1)
            rng = np.random.default_rng([seed, level, int(group["_group"].iloc[0]), key])
            size, fraction = group["size"].to_numpy(float), group["_part"].to_numpy(float)
            part, held = pivot(size, fraction, rng)
            left, drawn = np.zeros(len(group), bool), np.zeros(len(group))
            if held >= 0:
                if is_root:
                    up = float(rng.random() < part[held])
                    drawn[held] = size[held] * (up - part[held])
                    part[held] = up
                else:
                    left[held] = True
            return group.assign(_part=part, _left=left, _drawn=drawn)

        return run

    largest = targets.agg(F.max("_docs")).first()[0] or 0
    groups, level = -(-largest // GROUP), 0
    done, pending = None, rows
    while True:
        last = groups <= 1
        keys = ["_source", "_group"]
        result = stored(
            pending.groupBy(*keys).applyInPandas(rounded(level, last), schema)
        )
        settled = result.where(~F.col("_left"))
        done = settled if done is None else done.union(settled)
        if last:
            break
        groups, level = -(-groups // FAN_IN), level + 1
        above = F.floor(F.col("_group") / F.lit(FAN_IN)).cast("long")
        pending = result.where("_left").withColumn("_group", above).withColumn("_left", F.lit(False))

    def repaired(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["size", "_key"], ascending=[False, True], kind="stable", ignore_index=True
        )
        part = group["_part"].to_numpy(float).copy()
        # The document of the last draw stays as it was drawn.
        free = np.where(group["_drawn"] == 0, group["_fraction"], 0.0)
        repair(group["size"].to_numpy(float), free, part, float(group["_share"].iloc[0]))
        return group.assign(_part=part)

    shares = stored(shares_of_groups(done, level + 1))
    small = broadcast_if_small(shares)
    done = done.join(
        small, done["_source"].eqNullSafe(small["_of"]) & (done["_leaf"] == small["_at"]), "left"
    ).drop("_of", "_at")
    mended = done.where(F.col("_share").isNotNull())
    mended = mended.groupBy("_source", "_leaf").applyInPandas(repaired, mended.schema)
    done = done.where(F.col("_share").isNull()).union(mended)
    copies = F.col("_whole") + F.round("_part").cast("long")
    return done.select(
        "doc_id",
        F.col("_source").alias("source"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        "_key",
    )


def take_copies(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it, with copy (from 1).

    Rows that repeat doc_id and text are matched in any order.  A column named copy is replaced;
    other columns may have any name.
    """
    lists = mixed.groupBy("_key").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    here = Window.partitionBy("_key").orderBy("_key")
    # Numbering and join both go by the digest, so texts are shuffled once.
    key = F.xxhash64(*[F.col(f"_in{place(docs, name)}") for name in (doc_id, text)])
    keyed = numbered(docs).withColumn("_key", key)
    keyed = keyed.withColumn("_nth", F.row_number().over(here))
    joined = keyed.join(lists, "_key").withColumn("_times", F.get("_copies", F.col("_nth") - 1))
    taken = joined.where("_times > 0")
    number = F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("copy")
    return taken.select(*restored(docs, ["copy"]), number)
