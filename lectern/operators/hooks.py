"""Batch hooks for the two model calls; the model or client itself is the caller's.

Each hook takes a factory. It runs once per task, so weights or connections are opened there
and not on the driver, and the function it returns gets whole Arrow batches.
"""

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread_by_length(rows: DataFrame, key: str, text: str, tasks: int) -> DataFrame:
    """``(key, text)`` in ``tasks`` partitions with about the same number of characters each.

    Every partition orders its texts by length and deals them out one by one, from a place of its own
    on. So each task gets as many texts of every length as the others, however they were stored.
    """
    place = (1 << 33) - 1  # the row's number in its partition, below the partition's number
    dealt = (
        rows.select(key, text, F.coalesce(F.length(text), F.lit(0)).alias("_length"))
        .sortWithinPartitions(F.col("_length").desc(), key)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    start = F.xxhash64(F.shiftright("_row", 33)) % tasks
    task = F.pmod(F.col("_row").bitwiseAND(F.lit(place)) + start, F.lit(tasks)).cast("int")
    return dealt.select(key, text, task.alias("_task")).repartitionById(tasks, F.col("_task")).drop("_task")


def embed_texts(
    rows: DataFrame, key: str, text: str, encoder_factory: Callable[[], Callable],
    tasks: int | None = None,
) -> DataFrame:
    """``(key, embedding)``. The encoder maps a list of texts to a sequence of vectors.

    An encoder's time follows the characters it gets and not the bytes that were read together, so
    ``tasks`` deals the texts out by length first (one shuffle of the texts).
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for texts in batches:
            yield pd.Series(list(encoder(texts.tolist())), index=texts.index)

    if tasks is not None:
        rows = spread_by_length(rows, key, text, tasks)
    return rows.select(key, encode(F.col(text)).alias("embedding"))


def complete_prompts(
    requests: DataFrame, key: str, payload: str, client_factory: Callable[[], Callable],
    calls_at_once: int = 8, tasks: int | None = None,
) -> DataFrame:
    """``(key, response, error)``. A call that raises fills ``error`` and fails no other row.

    The client maps one request text to one response text. A task keeps ``calls_at_once``
    requests in flight; ``tasks`` spreads the requests first, as few bytes would otherwise share
    a task however long their calls take. Rows without a request are not sent.
    """
    schema = T.StructType(
        [
            requests.schema[key],
            T.StructField("response", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()

        def one(request):
            try:
                return client(request), None
            except Exception as problem:  # the row's fallback text is chosen from this
                return None, f"{type(problem).__name__}: {problem}"

        with ThreadPoolExecutor(calls_at_once) as pool:
            for batch in batches:
                answered = list(pool.map(one, batch[payload]))
                yield pd.DataFrame(
                    {
                        key: batch[key],
                        "response": [a[0] for a in answered],
                        "error": [a[1] for a in answered],
                    }
                )

    sent = requests.where(F.col(payload).isNotNull()).select(key, payload)
    if tasks is not None:
        sent = sent.repartition(tasks, key)
    return sent.mapInPandas(call, schema)
