"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are gzip files with one member per record.  The reader never opens a file as a whole: Spark
deals out byte ranges, the text source cuts each range at the gzip magic, and a task owns the
members that start inside its range.  Compressed data can hold the magic by chance, so the
first candidate of a range counts only if its gzip header and the start of its content decode to a
WARC record; what comes before is the rest of a record of the range before.  From there on a member
ends where its data says so, and a magic inside it is part of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.session import stored

#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: Ends a row in the text sink: a gzip member without content, which readers of gzip skip.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
ID_PREFIX = "urn:record:"

_FIELDS = (
    "record_type string, record_id string, url string, date string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)


def member(record: bytes) -> bytes:
    """A gzip member without time stamp, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + body + tail


def record(
    record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE
) -> bytes:
    """One response record, or a revisit record if it refers to another.

    The block is an HTTP answer; that of a revisit ends after the HTTP header, whose Content-Length
    still tells the size of the payload.
    """
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{quote(record_id, safe='')}>"),
        ("WARC-Date", date),
    ]
    if url is not None:
        # Line breaks and other control characters cannot stand in a header.
        fields.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")))
    fields.append(("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"))
    if refers_to:
        fields.append(("WARC-Refers-To", f"<{ID_PREFIX}{quote(refers_to, safe='')}>"))
        fields.append(("WARC-Profile", PROFILE))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def with_referrals(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """_id, _payload, _refers: the page that a record of an equal payload refers to, or null.

    The first page of each repeated digest is found by a pre-aggregated minimum; only digests that
    repeat are joined back, and a digest with very many pages is split by Spark.
    """
    rows = pages.withColumns(
        {"_payload": F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8"), "_id": F.col(page_id)}
    )
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    long_enough = F.octet_length("_payload") >= MIN_REVISIT_BYTES
    firsts = rows.where(long_enough).groupBy("_digest").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # Written, so that Spark knows its size: mostly it is small, and the payloads then stay put.
    firsts = stored(firsts.where("_n > 1").drop("_n"))
    joined = rows.join(firsts, "_digest", "left")
    is_first = F.col("_id").eqNullSafe(F.col("_first"))
    refers = F.when(long_enough & ~is_first, F.col("_first"))
    return joined.select("*", refers.alias("_refers"))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = DATE,
) -> None:
    """Writes one record per page into gzip files under ``path``, through Spark's own committer.

    Payload is the html in UTF-8, empty for null.  Of pages with equal payloads of at least
    ``MIN_REVISIT_BYTES`` bytes the one with the smallest id is a response, as are rows that repeat
    its id; the others revisit it.  A null id counts as larger than all others.  A null url gives a
    record without a target.  Tasks hold one batch of pages at a time, and any file system that
    Spark writes to will do.
    """
    rows = with_referrals(pages, page_id, html).select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")),
        F.col(url).cast("string"),
        "_payload",
        F.col("_refers").cast("string"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [
                member(record(*(value.as_py() for value in row), date=date))
                for row in zip(*batch.columns)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    members = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    # The text sink writes the bytes of a value as they are.
    options = {"encoding": "ISO-8859-1", "lineSep": EMPTY_MEMBER.decode("latin-1")}
    members.write.options(**options).text(path)


def begins_record(piece: bytes) -> bool:
    """Whether the bytes after a magic begin a member that holds a WARC record or nothing.

    Chance bytes do not unpack to the name of the format.  A record that the magic by chance cuts
    before its first five characters are unpacked is not recognised; ``_joined`` takes care of it.
    """
    unpacker = zlib.decompressobj(31)
    try:
        head = unpacker.decompress(MAGIC + piece[: 1 << 14], 5)
    except zlib.error:
        return False
    return head == b"WARC/" or (unpacker.eof and head == b"")


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by name in lower case, and what comes after the empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, rest


def _bare(value: str | None) -> str | None:
    if value is None:
        return None
    return unquote(value.strip("<>").removeprefix(ID_PREFIX))


def parsed(content: bytes) -> dict:
    """The fields of one record.

    The payload of a response is what follows its HTTP header, and its digest must be right.
    """
    fields, rest = headers(content)
    block = rest[: int(fields.get("content-length", 0))]
    http, payload = ({}, block)
    if block.startswith(b"HTTP/"):
        http, payload = headers(block)
    kind = fields.get("warc-type")
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None
    revisit = kind == "revisit"
    size = int(http.get("content-length", 0)) if revisit else len(payload)
    if not revisit:
        found = hashlib.sha256(payload).hexdigest()
        if (fields.get("warc-payload-digest") or "").startswith("sha256:") and digest != found:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not fit its digest")
        digest = found
    return {
        "record_type": kind,
        "record_id": _bare(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "payload_digest": digest,
        "refers_to": _bare(fields.get("warc-refers-to")),
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


_RECORD = pa.struct(
    [
        ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()),
        ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: type, id, url, date, digest, refers_to, payload_bytes, payload.

    Works on any gzip archive with one record per member; a revisit has no payload of its own.
    Pieces that go over the end of a byte range, which takes a magic by chance in the last member
    of a range, are the only rows that are shuffled.  Files must not be named ``.gz``, since Spark
    reads such files unsplit and unpacked.  An empty folder of archives gives no rows.
    """
    text = (
        spark.read.options(encoding="ISO-8859-1", lineSep=MAGIC.decode("latin-1"))
        .schema("value string")
        .text(path)
    )
    place = F.col("_metadata")
    pieces = text.select(
        F.col("value").cast("binary"),
        place["file_path"].alias("file"),
        place["file_block_start"].alias("start"),
        (place["file_block_start"] + place["file_block_length"]).alias("end"),
    )
    # One row per finished record; otherwise the bytes that open or continue one, by byte range.
    inner = ", ".join(field.replace(" ", ":") for field in _FIELDS.split(", "))
    schema = (
        f"record struct<{inner}>, file string, start long, end long, "
        "kind int, part int, bytes binary"
    )
    cut = stored(pieces.mapInArrow(_own_members, schema))
    whole = cut.where("kind = 0").select("record.*")
    loose = cut.where("kind > 0").groupBy("file").applyInPandas(_joined, _FIELDS)
    return whole.unionByName(loose)


def _own_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each byte range.

    kind 0: a record.  kind 1: pieces before the first member of the range, which belong to the
    range before.  kind 2: the last member of a range, if it is not finished there.
    """
    out: list[tuple] = []
    at: tuple | None = None
    unpacker, content, packed = None, b"", bytearray()
    part, synced = 0, False

    def feed(data: bytes) -> None:
        """Unpacks more of the member that is open, and ends it where its data ends."""
        nonlocal unpacker, content, packed
        content += unpacker.decompress(data)
        packed += data
        if unpacker.eof:
            if content:
                out.append((parsed(content), *at, 0, 0, None))
            unpacker = None

    def close() -> None:
        nonlocal unpacker
        if unpacker is not None:
            out.append((None, *at, 2, part + 1, bytes(packed)))
            unpacker = None

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        types = [_RECORD, pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["record", "file", "start", "end", "kind", "part", "bytes"]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for value, *place in zip(*batch.columns):
            where = tuple(x.as_py() for x in place)
            if where != at:
                close()
                at, part, synced = where, 0, False
            piece = value.as_py()
            part += 1
            if part == 1 and where[1] == 0:
                continue  # what stands before the first magic of a file, mostly nothing
            if unpacker is None:
                synced = synced or begins_record(piece)
                if not synced:
                    out.append((None, *at, 1, part, MAGIC + piece))
                    continue
                unpacker, content, packed = zlib.decompressobj(31), b"", bytearray()
            feed(MAGIC + piece)
        if out:
            yield batch_of()
    close()
    if out:
        yield batch_of()


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The members of one file that were not read in one range: few, mostly none.

    In order of the file, each piece goes on with the member that is open, or opens the next.
    """
    rows, unpacker, content = [], None, b""
    for piece in group.sort_values(["start", "part"]).itertuples():
        if unpacker is None:
            unpacker, content = zlib.decompressobj(31), b""
        content += unpacker.decompress(bytes(piece.bytes))
        if unpacker.eof:
            if content:
                rows.append(parsed(content))
            unpacker = None
    if unpacker is not None:
        raise ValueError(f"the last record of {group['file'].iloc[0]} has no end")
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _FIELDS.split(", ")])
