"""WARC archives (9): written by Spark, read back in splits with boundary-chain verification.

The reader cuts files at every record magic, true or not, so that splits of a file are read by many
tasks. Each piece is a candidate record: its header says where its successor must begin. Offsets come
from the piece lengths, added up over the splits of a file. Pointers from candidate to successor are
then doubled, starting at offset 0 of each file; what is reached is a record, and any other candidate
is a magic inside some payload, whose pieces are put together again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.cluster import new_shared_path
from lectern.llm.common import stored

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

#: Files are divided into ranges of this size to find what lies inside a record.
RANGE_BYTES = 1 << 20
#: Up to so many pieces' places are sent to all tasks; more are joined.
BROADCAST_PIECES = 100_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base 32: each 5 hexadecimal digits are 4 digits of base 32."""
    digits = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(F.sha1(payload), i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """A record per row. Of records with equal payloads of at least ``least_bytes`` bytes the one with
    the largest id is the response, others are revisits without payload that refer to it.

    A null payload is empty, a null url is left out and a null id never is the largest. Rows that
    share the largest id are all responses.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("rank"),
        F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": base32_sha1(F.col("payload"))})
    digests = stored(rows.select("rank", "digest", "bytes"), "digests")
    shared = digests.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("rank").alias("first"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "shared-payloads")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("rank").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    refers = F.concat(F.lit(f"WARC-Profile: {IDENTICAL}\r\nWARC-Refers-To: <{RECORD_ID}"), F.col("first").cast("string"), F.lit(">\r\n"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{RECORD_ID}"), F.coalesce("id", F.lit("null")), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), "url", F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r"),
    )  # the writer's line end is the last byte of a record
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", "\n").text(path)


def parsed(piece: bytes) -> dict | None:
    """Header fields of a piece (what stands between two magics), or None if it has no whole header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    start = end + 4
    return {
        "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "block": start, "stop": start + int(length), "after": start + int(length) + 4,
    }


def payload_of(piece: bytes, head: dict) -> tuple[int, str]:
    """(bytes, digest) of the full payload: read if it is there; of a revisit, as its headers say."""
    block = piece[head["block"] : head["stop"]]
    at = block.find(b"\r\n\r\n") + 4
    if head["type"] != "revisit":
        payload = block[at:] if at >= 4 else block
        return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    told = [x.partition(b":")[2].strip() for x in block[:at].split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return (int(told[0]) if told and told[0].isdigit() else 0), head["digest"]


_FIELDS = "type string, record_id string, refers_to string, payload_bytes long, payload_digest string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """All pieces in file order within their split: ``path``, ``split``, ``value``."""
    pieces = spark.read.option("lineSep", MAGIC).text(path)
    return pieces.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, split, place in the bytes that the split reads, piece)."""
    here, place = None, 0
    for batch in batches:
        for path, split, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, split) != here:
                here, place = (path, split), 0
            yield path, split, place, value
            place += len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "split", "place", "size", "step", "whole", *(f.split()[0] for f in _FIELDS.split(", "))]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    rows: list[tuple] = []
    for path, split, place, value in _placed(batches):
        head = parsed(value)
        whole = head is not None and len(value) == head["after"]
        told = payload_of(value, head) if whole else (None, None)
        ids = (head["type"], head["record_id"], head["refers_to"]) if head else (None, None, None)
        rows.append((path, split, place, len(value), head["after"] if head else None, whole, *ids, *told))
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


def reachable(pointers: DataFrame) -> DataFrame:
    """(``path``, ``at``) of the candidates on the chain from offset 0, by pointer jumping.

    ``pointers`` has ``path``, ``at`` and ``to``. In each round the pointers of what is reached so far
    reach as many again, and each pointer takes the place of two: log2(records of a file) rounds.
    """
    reached = stored(pointers.where("at = 0").select("path", "at"), "reached")
    known = pointers.select("path", F.col("at").alias("to"))
    jumps = stored(pointers.join(known, ["path", "to"], "left_semi").select("path", "at", "to"), "jumps")
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = stored(reached.unionByName(ahead).distinct(), "reached")
        second = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = stored(jumps.join(second, ["path", "to"]).select("path", "at", F.col("far").alias("to")), "jumps")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_id``, ``type``, ``refers_to``, ``payload_bytes`` and ``payload_digest`` of each record.

    A header that is broken ends its file there: what follows can't be told from payload. Files may
    hold any bytes; an empty file has no records.
    """
    kinds = f"path string, split long, place long, size long, step long, whole boolean, {_FIELDS}"
    # Files go by a 64-bit hash of their path from here on, which keeps the pointers narrow.
    found = _pieces(spark, path).mapInArrow(_candidates, kinds).withColumn("path", F.xxhash64("path"))
    found = stored(found, "candidates")
    totals = found.groupBy("path", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select("path", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "split-bases")
    # A piece begins after its magic, so that what precedes the first magic of a file gets no candidate.
    at = F.col("base") + F.col("place") - len(MAGIC)
    placed = found.join(bases, ["path", "split"]).withColumn("at", at).where("at >= 0")
    placed = stored(placed.withColumn("to", F.col("at") + len(MAGIC) + F.col("step")).drop("base", "split", "place"), "placed")
    reached = reachable(placed.select("path", "at", "to"))
    records = placed.join(reached, ["path", "at"])
    torn = stored(records.where("NOT whole AND to IS NOT NULL").select("path", "at", "to"), "torn")
    whole = records.where("whole")
    if not torn.isEmpty():
        whole = whole.select("record_id", "type", "refers_to", "payload_bytes", "payload_digest").unionByName(
            _put_together(spark, path, placed, bases, torn)
        )
    return whole.select("record_id", "type", "refers_to", "payload_bytes", "payload_digest")


def _put_together(spark: SparkSession, path: str, placed: DataFrame, bases: DataFrame, torn: DataFrame) -> DataFrame:
    """The records ``torn`` by magics inside them, from a second read of their pieces."""
    part = F.col("at").cast("long")
    spans = torn.select("path", F.col("at").alias("owner"), "to", F.explode(F.sequence(F.floor(F.col("at") / RANGE_BYTES), F.floor((F.col("to") - 1) / RANGE_BYTES))).alias("range"))
    pieces = placed.select("path", part.alias("at"), F.floor(F.col("at") / RANGE_BYTES).alias("range"))
    inside = (F.col("at") >= F.col("owner")) & (F.col("at") < F.col("to"))
    wanted = stored(pieces.join(spans, ["path", "range"]).where(inside).select("path", "at", "owner"), "wanted")
    few = wanted.count() <= BROADCAST_PIECES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, split, place, value in _placed(batches):
            yield pa.RecordBatch.from_pydict({"path": [path], "split": [split], "place": [place], "value": [value]})

    files = torn.select("path").distinct()
    pieces = _pieces(spark, path).withColumn("path", F.xxhash64("file_path"))
    rows = pieces.join(F.broadcast(files) if few else files, "path", "left_semi").select("file_path", "file_block_start", "value")
    rows = rows.mapInArrow(emit, "path string, split long, place long, value binary")
    rows = rows.withColumn("path", F.xxhash64("path")).join(bases, ["path", "split"])
    rows = rows.select("path", (F.col("base") + F.col("place") - len(MAGIC)).alias("at"), "value")
    rows = rows.join(F.broadcast(wanted) if few else wanted, ["path", "at"])
    grouped = rows.groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column("parts").to_pylist():
                piece = MAGIC.encode().join(p["value"] for p in parts)
                head = parsed(piece)
                size, digest = payload_of(piece, head)
                yield pa.RecordBatch.from_pydict(
                    {"type": [head["type"]], "record_id": [head["record_id"]], "refers_to": pa.array([head["refers_to"]], pa.string()), "payload_bytes": [size], "payload_digest": [digest]}
                )

    return grouped.select("parts").mapInArrow(join, _FIELDS)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read these back.

    Per page: id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. Repeated rows
    are records each; a null id comes back as null; an empty table gives no rows.
    """
    path = new_shared_path(pages.sparkSession, "archives")
    write_archives(pages, path, id_col, url_col, payload_col, least_bytes)
    page = F.when(F.col("record_id") != f"{RECORD_ID}null", F.substring_index("record_id", ":", -1).cast("long"))
    return read_archives(pages.sparkSession, path).select(
        page.alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.substring_index("refers_to", ":", -1).cast("long").alias("refers_to"),
    )
