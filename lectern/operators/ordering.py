"""Per-group numbering, successors and ordered concatenation that survive hot groups.

A window over a group sorts that group in one task. That is right for ordinary groups and
wrong for one that holds a third of all rows, or a few rows with a third of all bytes, so every
operator here first measures the groups (a map-side combined aggregate over the key columns and,
where texts are joined, their lengths). Groups above ``hot_rows`` or ``hot_bytes`` are
range-partitioned over key *and* order into as many pieces as their size asks for, numbered piece by
piece and shifted by the sizes of the pieces before; all others use one plain window.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.cluster import cut_lineage

HOT_GROUP_ROWS = 1_000_000
HOT_GROUP_BYTES = 256 << 20
# What one task gets of the hot groups, and what is joined to one block of text.
PIECE_ROWS, PIECE_BYTES = 500_000, 64 << 20
CONCAT_BLOCK_BYTES = 8 << 20
# Every row of a text counts so much besides the text itself.
ROW_BYTES = 64


def _on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on ``keys`` that keeps only the left copy of them."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


class HotRows:
    """The rows of the hot groups, and how many pieces they make."""

    def __init__(self, rows: DataFrame, pieces: int):
        self.rows, self.pieces = rows, pieces


def _measured(
    df: DataFrame, keys: Sequence[str], hot_rows: int, weight: Column | None = None,
    hot_bytes: int = HOT_GROUP_BYTES,
) -> DataFrame | None:
    """Key, ``_rows`` and ``_bytes`` of the hot groups, written once; None if there are none.

    There are at most rows / ``hot_rows`` + bytes / ``hot_bytes`` of them.
    """
    weight = F.lit(0) if weight is None else weight
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum(weight).alias("_bytes"))
    hot = cut_lineage(sizes.where((F.col("_rows") > hot_rows) | (F.col("_bytes") > hot_bytes)))
    return None if hot.isEmpty() else hot


def _split(
    df: DataFrame, keys: Sequence[str], hot_rows: int, counted: DataFrame | None = None,
    weight: Column | None = None, hot_bytes: int = HOT_GROUP_BYTES,
) -> tuple[DataFrame, HotRows | None]:
    hot = _measured(df if counted is None else counted, keys, hot_rows, weight, hot_bytes)
    if hot is None:
        return df, None
    size = hot.agg(F.sum("_rows").alias("rows"), F.sum("_bytes").alias("bytes")).first()
    # A piece is no larger than a group that is not hot.
    rows, held = min(PIECE_ROWS, hot_rows), min(PIECE_BYTES, hot_bytes)
    pieces = max(2, -(-size["rows"] // max(1, rows)), -(-(size["bytes"] or 0) // max(1, held)))
    names = hot.select(*keys)
    ordinary = _on_keys(df, names, keys, "left_anti")
    return ordinary, HotRows(_on_keys(df, names, keys, "left_semi"), pieces)


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``(rows of ordinary groups, rows of hot groups or None)``.

    There are at most ``rows / hot_rows`` hot keys, so the joins against them stay small.
    ``counted`` may name a frame that is cheaper to count and has at least as many rows of
    every key.
    """
    ordinary, hot = _split(df, keys, hot_rows, counted)
    return ordinary, None if hot is None else hot.rows


def _number_plain(df, keys, order, out):
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _number_hot(hot: HotRows, keys, order, out, weight=None):
    """``out``, and with ``weight`` also ``_upto``: the weight of the group's rows before this one."""
    # The piece number must be the same for both uses below, hence materialised once.
    rows = cut_lineage(
        hot.rows.repartitionByRange(hot.pieces, *keys, *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    weight = F.lit(0) if weight is None else weight
    until_here = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    pieces = rows.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    offsets = pieces.select(
        *keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_weight"),
    )
    local = _number_plain(rows, [*keys, "_piece"], order, "_local").withColumn(
        "_upto", F.sum(weight).over(until_here) - weight
    )
    return (
        _on_keys(local, offsets, [*keys, "_piece"], "left")
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .withColumn("_upto", F.col("_upto") + F.col("_weight"))
        .drop("_piece", "_local", "_offset", "_weight")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str,
    hot_rows: int = HOT_GROUP_ROWS, counted: DataFrame | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``order`` should be total."""
    ordinary, hot = _split(df, keys, hot_rows, counted)
    numbered = _number_plain(ordinary, keys, order, out).withColumn(out, F.col(out).cast("long"))
    if hot is None:
        return numbered
    return numbered.unionByName(_number_hot(hot, keys, order, out).drop("_upto"))


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``columns[name]`` = value of ``name`` in the next row of the group."""
    ordinary, hot = _split(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    paired = ordinary.withColumns({new: F.lead(old).over(window) for old, new in columns.items()})
    if hot is None:
        return paired
    numbered = cut_lineage(_number_hot(hot, keys, order, "_n").drop("_upto"))
    following = numbered.select(
        *keys, (F.col("_n") - 1).alias("_n"), *[F.col(o).alias(n) for o, n in columns.items()]
    )
    # The equi-join is on (key, position): a hot key spreads over all tasks.
    return paired.unionByName(_on_keys(numbered, following, [*keys, "_n"], "left").drop("_n"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group; Spark keeps one row per key and task before the shuffle."""
    return first_rows(df, keys, order, 1, "_n").drop("_n")


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str
) -> DataFrame:
    """First ``n`` rows of each group with their number.

    ``row_number() <= n`` plans a WindowGroupLimit on both sides of the exchange, so a hot
    group sends at most ``n`` rows per task.
    """
    return _number_plain(df, keys, order, out).where(F.col(out) <= n)


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], separator: str,
    texts: dict[str, Column], totals: dict[str, Column] | None = None,
    hot_rows: int = HOT_GROUP_ROWS, hot_bytes: int = HOT_GROUP_BYTES,
    block_bytes: int = CONCAT_BLOCK_BYTES, number: str = "_n",
    counted: DataFrame | None = None, as_text: Callable[[Column], Column] | None = None,
    text_bytes: Column | None = None,
) -> DataFrame:
    """One row per group: its row count ``rows``, each text joined in order, each total summed.

    The expressions may use the row's number in its group, under the name ``number``.
    ``as_text`` turns an ordered array of values into one text, for values that are not texts
    themselves. A group is hot by its rows or by its bytes; ``text_bytes`` is about what a row adds to
    the texts, and without it rows alone count. The rows of a hot group are first joined to blocks
    of about ``block_bytes`` in parallel; only finished blocks meet in one task, because the result
    itself is one string. ``counted`` (as in ``split_hot``) must hold the columns of ``text_bytes``.
    """
    totals = totals or {}
    plain_join = lambda values: F.array_join(values, separator)
    weight = F.lit(ROW_BYTES).cast("long")
    if text_bytes is not None:
        weight = weight + F.coalesce(text_bytes, F.lit(0))
    ordinary, hot = _split(df, keys, hot_rows, counted, weight, hot_bytes)

    def lines(numbered, *more):
        values = [e.alias(name) for name, e in {**texts, **totals}.items()]
        return numbered.select(*keys, *more, F.col(number).alias("_at"), *values)

    def joined(rows, by, count, to_text):
        listed = rows.groupBy(*by).agg(
            count.alias("rows"), *[F.sum(name).alias(name) for name in totals],
            F.sort_array(F.collect_list(F.struct("_at", *texts))).alias("_list"),
        )
        return listed.select(
            *by, "rows", *totals,
            *[to_text(F.col("_list").getField(name)).alias(name) for name in texts],
        )

    first = as_text or plain_join
    whole = joined(lines(_number_plain(ordinary, keys, order, number)), keys, F.count("*"), first)
    if hot is None:
        return whole
    block = F.floor(F.col("_upto") / block_bytes).alias("_block")
    blocks = joined(
        lines(_number_hot(hot, keys, order, number, weight), block), [*keys, "_block"], F.count("*"),
        first,
    )
    return whole.unionByName(
        joined(blocks.withColumnRenamed("_block", "_at"), keys, F.sum("rows"), plain_join)
    )
