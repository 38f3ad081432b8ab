"""Shards (11) on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` places. A text lies at the place its digest names, so equal texts lie together;
each shard owns ``NODES`` places spread by hash. A place's texts belong to the first shard met
clockwise that still has room, where a shard's room is its even share of all bytes and a little
slack. As only the bytes of each place decide, the walk is planned over the histogram of the places,
heaviest first, and rows then look up the plan. Copies of one text that weigh much are dealt to
blocks by id; the blocks stay in one shard unless none can take them all.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

#: Places on the ring, and places that each shard owns.
CELLS, NODES = 1 << 16, 128
#: A shard's room is its even share of the bytes and this much more.
SLACK = 0.0002
#: Copies of a text are dealt to blocks when they hold over 1 / BLOCKS of a shard's share of bytes or rows.
BLOCKS = 64


class Ring:
    """Which shards a place meets, going clockwise."""

    def __init__(self, shards: int, nodes: int = NODES) -> None:
        at = [
            (int.from_bytes(hashlib.blake2b(f"{shard}:{node}".encode(), digest_size=4).digest()) % CELLS, shard)
            for shard in range(shards) for node in range(nodes)
        ]
        at.sort()
        self.places, self.owners = np.array([p for p, _ in at]), [s for _, s in at]
        self.walks: dict[int, list[int]] = {}

    def walk(self, cell: int) -> list[int]:
        """All shards, in the order in which they are met from ``cell`` on."""
        start = int(np.searchsorted(self.places, cell)) % len(self.owners)
        if start not in self.walks:
            self.walks[start] = list(dict.fromkeys(self.owners[start:] + self.owners[:start]))
        return self.walks[start]


def bounded_loads(items: list[tuple[int, list[tuple[int, int]]]], shards: int, slack: float = SLACK, nodes: int = NODES) -> dict[int, int]:
    """Shard of every unit. An item is a place and its units, each a number and its weight.

    Heavier items choose first. An item goes whole to the first shard clockwise with room for all its
    weight; if there is none, its units go on clockwise one by one; a unit that no shard has
    room for goes to the least loaded.
    """
    ring, loads, chosen = Ring(shards, nodes), [0] * shards, {}
    total = sum(weight for _, units in items for _, weight in units)
    room = int(np.ceil(total / shards * (1 + slack)))

    def place(cell: int, units: list[tuple[int, int]]) -> bool:
        weight = sum(w for _, w in units)
        walk = ring.walk(cell)
        shard = next((s for s in walk if loads[s] + weight <= room), None)
        if shard is None and len(units) > 1:
            return False
        if shard is None:
            shard = min(walk, key=loads.__getitem__)
        loads[shard] += weight
        chosen.update((unit, shard) for unit, _ in units)
        return True

    for cell, units in sorted(items, key=lambda i: (-sum(w for _, w in i[1]), i[1][0][0])):
        if not place(cell, units):
            for unit in sorted(units, key=lambda u: (-u[1], u[0])):
                place(cell, [unit])
    return chosen


@dataclass
class ShardPlan:
    """``rows`` holds each id with its text's digest, ``size``, ``text_crc32`` and number of ``copies``,
    ``large`` the blocks of heavy texts, ``units`` the shard and first slot of each unit; the last
    two are small whatever the corpus is."""

    rows: DataFrame
    large: DataFrame
    units: DataFrame
    limits: tuple[int, int]


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _cell(key: Column) -> Column:
    return F.conv(F.substring(F.hex(key), 1, 4), 16, 10).cast("int")


def _parts(size: Column, copies: Column, limits: tuple[int, int]) -> Column:
    """Into how many parts the copies of one row are cut."""
    parts = F.ceil(F.greatest(copies * size / limits[0], copies / limits[1]))
    return F.greatest(F.lit(1), F.least(parts, copies)).cast("long")


def _in_units(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``unit`` of rows with ``key``, ``id`` and ``part``: a block of a heavy text, else its place."""
    block = F.col("_base") + F.pmod(F.xxhash64("id", "part"), F.col("_blocks"))
    heavy = large.withColumnRenamed("key", "_key")
    return (
        rows.join(F.broadcast(heavy), F.col("key") == F.col("_key"), "left")
        .withColumn("unit", F.coalesce(block, _cell(F.col("key")).cast("long")))
        .drop("_key", "_base", "_blocks")
    )


def _dealt(plan_rows: DataFrame, large: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """Rows with their unit; the copies of a row that fill more than a block are cut into parts."""
    cut = plan_rows.withColumn("_parts", _parts(F.col("size"), F.col("copies"), limits))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    upto = lambda part: F.floor(F.col("copies") * part / F.col("_parts"))
    copies = upto(F.col("part") + 1) - upto(F.col("part"))
    return _in_units(cut.withColumn("copies", copies).drop("_parts"), large)


def plan_shards(docs: DataFrame, shards: int = 16, slack: float = SLACK, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> ShardPlan:
    """Place every document in one of ``shards`` shards so that their bytes are near equal.

    The weight of a document is its text's UTF-8 bytes plus 1; a null text counts as empty. What goes
    to the driver is the histogram of the ring, at most ``CELLS`` rows, and the texts that hold
    over 1 / ``BLOCKS`` of a shard's share, at most 2 * ``BLOCKS`` * ``shards``.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.unhex(_digest(text)).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "shard-rows")
    weigh = [F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")]

    cells = rows.groupBy(_cell(F.col("key")).alias("cell")).agg(*weigh).toArrow().to_pandas()
    limits = tuple(max(1, int(cells[c].sum()) // (BLOCKS * shards)) for c in ("bytes", "rows"))
    over = (F.col("bytes") > limits[0]) | (F.col("rows") > limits[1])
    crowded = cells[(cells["bytes"] > limits[0]) | (cells["rows"] > limits[1])]["cell"].tolist()
    heavy = (
        rows.where(_cell(F.col("key")).isin(crowded)).groupBy("key").agg(*weigh).where(over)
        .select("key", _cell(F.col("key")).alias("cell"), _parts(F.col("bytes") / F.col("rows"), F.col("rows"), limits).alias("blocks"))
        .orderBy("key").toArrow()
    )
    blocks = np.asarray(heavy["blocks"], np.int64)
    base = CELLS + np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.int64)[: len(blocks)]
    large = spark.createDataFrame(
        pa.table({"key": heavy["key"], "_base": pa.array(base), "_blocks": pa.array(blocks)}), "key binary, _base long, _blocks long"
    )

    weights = _dealt(rows, large, limits).groupBy("unit").agg(*weigh).orderBy("unit").toArrow()
    owner = np.concatenate([np.arange(CELLS), CELLS + np.repeat(np.arange(len(blocks)), blocks)])
    places = np.concatenate([np.arange(CELLS), np.asarray(heavy["cell"], np.int64)])
    items: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    numbers, counts = weights["unit"].to_pylist(), np.asarray(weights["rows"], np.int64)
    for unit, weight in zip(numbers, weights["bytes"].to_pylist(), strict=True):
        item = int(owner[unit])
        items.setdefault(item, (int(places[item]), []))[1].append((unit, weight))
    chosen = bounded_loads(list(items.values()), shards, slack, nodes)
    shard = np.array([chosen[unit] for unit in numbers], np.int32)
    first = np.zeros(len(shard), np.int64)
    for s in range(shards):
        first[shard == s] = np.cumsum(counts[shard == s]) - counts[shard == s]
    units = pa.table({"unit": weights["unit"], "shard": pa.array(shard), "first": pa.array(first)})
    return ShardPlan(rows, large, spark.createDataFrame(units, "unit long, shard int, first long"), limits)


def placements(plan: ShardPlan, id_col: str = "doc_id") -> DataFrame:
    """Per document its id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1 … within the shard).

    Every row counts, repeated ones and null ids too; an empty table gives none.
    """
    before = Window.partitionBy("unit").orderBy("key", "id", "part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("copies").over(before), F.lit(0))
    numbered = _dealt(plan.rows, plan.large, plan.limits).join(F.broadcast(plan.units), "unit").withColumn("_start", start)
    each = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("_start") + F.col("_copy")).alias("slot")
    )


def with_shard(docs: DataFrame, plan: ShardPlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns and whole texts, with their ``shard``; no text is shuffled.

    Columns of any name stay, but for an own ``shard``, which is replaced. Copies of one row that
    fill more than a block are dealt to its parts by row number.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"])
    plain = docs.select(row.alias("_row")).select(
        "_row", F.unhex(_digest(F.col("_row").getField(text_col))).alias("key"), F.col("_row").getField(id_col).alias("id"),
        F.monotonically_increasing_id().alias("_place"),
    )
    parts = _parts(F.col("size"), F.col("copies"), plan.limits)
    repeats = plan.rows.where("copies > 1").select(F.col("key").alias("_k"), F.col("id").alias("_i"), parts.alias("_parts")).where("_parts > 1")
    same = (F.col("key") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_i"))
    parted = plain.join(F.broadcast(repeats), same, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("_place"), F.col("_parts")), F.lit(0).cast("long"))
    )
    found = _in_units(parted, plan.large).join(F.broadcast(plan.units), "unit")
    return found.select("_row.*", "shard")


def write_shards(docs: DataFrame, plan: ShardPlan, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, one folder ``shard=N`` per shard."""
    with_shard(docs, plan, id_col, text_col).write.partitionBy("shard").parquet(path)
