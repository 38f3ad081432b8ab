"""Growing shares of a table, for searches whose bounds should follow the table's size.

A search for the k best rows of each question that runs over all tasks at once lets every task give
k rows. Run over a growing share instead, each step knows the k-th best of the share before:
of the rows new in a step only about k * (share / share before - 1) per question can still win,
however many tasks there are. Every row is compared once in all.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first share has at most four times as many rows as the bounds are seeded from.
SEED_ROWS = 4096
_PLACES = 1 << 30


def growing_shares(rows: int, seed_rows: int = SEED_ROWS) -> list[tuple[float, float]]:
    """Steps ``(from, to)`` as shares of the table, that together are all of it.

    The last doubles what was seen, so that about k rows per question come from it; those before
    take four times what was seen.
    """
    if rows <= 2 * seed_rows:
        return [(0.0, 1.0)]
    edges, share = [1.0], 0.5
    while share * rows > seed_rows:
        edges.append(share)
        share /= 4
    edges.append(0.0)
    return list(zip(edges[:0:-1], edges[-2::-1]))


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_PLACES))


def share_of(df: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """The rows whose hashed key lies in the share; a null key lies somewhere too."""
    if (low, high) == (0.0, 1.0):
        return df
    place = _place(F.col(key))
    return df.where((place >= int(low * _PLACES)) & (place < int(high * _PLACES)))


def seed_sample(df: DataFrame, key: str, rows: int, seed_rows: int = SEED_ROWS) -> DataFrame:
    """About ``seed_rows`` rows, at most twice as many; ``rows`` is the size of ``df``."""
    share = min(1.0, seed_rows / max(1, rows))
    return share_of(df, key, 0.0, share).limit(2 * seed_rows)
