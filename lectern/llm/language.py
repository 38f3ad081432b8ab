"""Language identification (1) by Bayesian evidence fusion.

A row's language gets the likelihood of its text under character trigrams, the likelihood of what its
markup declares, and a prior of its host. Priors come from grouped sums of text posteriors: a host's
own counts are smoothed by those of its domain, these by those of its address suffix, and these by all rows.
One class more, ``und``, has flat trigrams and takes texts that are like no language known.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, text_slices

#: Trigrams are hashed to so many buckets.
BUCKETS = 1 << 14
#: Text likelihoods count as if a text had at most so many independent trigrams.
MOST_TRIGRAMS = 60
#: Rows that the parent level is worth when it smooths a level of the host hierarchy.
PARENT_ROWS = 5.0
#: Rows that the belief is worth that a declared language is right with the chance ``TRUSTED``.
DECLARED_ROWS, TRUSTED = 20.0, 0.9
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letters (bytes; anything else is a space) of all texts, and the first
    one of each text (and the end). Trigrams that begin with two spaces are left out."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    letters = _LETTERS[np.frombuffer(b"  " + b"  ".join(coded) + b"  ", np.uint8)]
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    held = (a != 32) | (b != 32)
    codes = (((a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA77) + c) * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
    bounds = np.cumsum([0, *(len(x) + 2 for x in coded)])
    return codes[held], np.concatenate([[0], np.cumsum(held)])[np.minimum(bounds, len(held))]


@dataclass
class TextModel:
    """``languages`` (the last is ``und``) and the logarithm of each bucket's chance in them."""

    languages: list[str]
    chances: np.ndarray

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, trigrams of each text); likelihoods of at most ``MOST_TRIGRAMS``."""
        codes, first = trigrams(texts)
        counts = np.diff(first)
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            for i, row in enumerate(self.chances):
                sums[some, i] = np.add.reduceat(row[codes], first[some])
        return sums * (np.minimum(counts, MOST_TRIGRAMS) / np.maximum(counts, 1))[:, None], counts


def fit_text_model(labelled: DataFrame, text_col: str, language_col: str, max_rows: int = 20_000) -> TextModel:
    """Trigram counts per language from about ``max_rows`` distinct texts of each language, chosen by a
    hash of the text, and from all of a language that has fewer, so that a language is known however
    large the table is. Copies count once. Without labelled rows there is only ``und``."""
    rows = labelled.select(F.lower(F.trim(F.col(language_col))).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    held = rows.groupBy("lang", "hash").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("texts"))
    shares = stored(held.select("lang", F.least(F.lit(1.0), max_rows / F.col("texts")).alias("share")), "language-shares")
    place = F.shiftrightunsigned(F.xxhash64("hash"), 12) / F.lit(float(1 << 52))
    sample = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).dropDuplicates(["lang", "hash"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                codes, first = trigrams(texts)
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(codes[first[i] : first[i + 1]], minlength=BUCKETS)
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()), "n": pa.array(found[at])})

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # languages x buckets at most
    names = sorted(set(table.column("lang").to_pylist()) - {UNKNOWN})
    sums = np.full((len(names) + 1, BUCKETS), 0.5)
    for lang, bucket, n in zip(*(table.column(c).to_pylist() for c in ("lang", "bucket", "n")), strict=True):
        if lang in names:
            sums[names.index(lang), bucket] += n
    sums[-1] = 1.0
    return TextModel([*names, UNKNOWN], np.log(sums / sums.sum(axis=1, keepdims=True)))


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` with ``text`` replaced by ``trigrams``, ``loglik`` and ``posterior`` (text alone)."""
    names = [c for c in rows.columns if c != "text"]
    lists = pa.list_(pa.float64())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                logs, counts = model.log_likelihoods(texts)
                chances = np.exp(logs - logs.max(axis=1, keepdims=True))
                chances /= chances.sum(axis=1, keepdims=True)
                columns = {n: part.column(n) for n in names} | {"trigrams": pa.array(counts, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {"loglik": pa.array(list(logs), lists), "posterior": pa.array(list(chances), lists)})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(score, ", ".join([*fields, "trigrams long, loglik array<double>, posterior array<double>"]))


def _sums(scored: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Per group the sum of posteriors by language; combined before the shuffle."""
    sums = [F.coalesce(F.sum(F.col("posterior")[i]), F.lit(0.0)) for i in range(size)]
    return scored.groupBy(*by).agg(F.array(*sums).alias("counts"))


def _smoothed(counts: Column, parent: Column) -> Column:
    rows = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(counts.alias("c"), parent.alias("p")), lambda z: (z["c"] + PARENT_ROWS * z["p"]) / (rows + PARENT_ROWS))


def host_priors(scored: DataFrame, size: int, overall: Column) -> DataFrame:
    """(``host``, ``host_counts``, ``parent``): own counts, and the smoothed prior of the domain."""
    hosts = stored(_sums(scored.where("host IS NOT NULL"), ["host", "domain", "suffix"], size).withColumnRenamed("counts", "posterior"), "hosts")
    suffixes = stored(_sums(hosts, ["suffix"], size).select("suffix", _smoothed(F.col("counts"), overall).alias("above")), "suffixes")
    domains = _sums(hosts, ["domain", "suffix"], size).join(suffixes, "suffix")
    domains = stored(domains.select("domain", _smoothed(F.col("counts"), F.col("above")).alias("parent")), "domains")
    return stored(hosts.join(domains, "domain").select("host", F.col("posterior").alias("host_counts"), "parent"), "host-priors")


def address_parts(host: Column) -> dict[str, Column]:
    """``domain`` (the last two labels) and ``suffix`` (the last one) of a host."""
    return {"domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def identified(rows: DataFrame, model: TextModel, carried: Sequence[str], text_col: str, declared_col: str, host_col: str, least: float = 0.5) -> DataFrame:
    """The columns ``carried`` of each row with ``language``, ``probability`` and ``accepted``.

    ``accepted``: the text has letters, the language is not ``und`` and its probability is ``least``
    or more. A row without text, declaration or host lacks that evidence alone: a null text or one without
    letters is ``und`` with probability 0, a null host takes the prior of all rows. A row's own
    text is left out of its host's counts. Repeated rows count each and get equal results. Columns
    that aren't carried are ignored; an empty table gives no rows.
    """
    size = len(model.languages)
    own = {f"_carried_{i}": F.col(c) for i, c in enumerate(carried)}
    host = F.lower(F.col(host_col))
    declared = F.regexp_extract(F.lower(F.trim(F.col(declared_col))), "^[a-z]+", 0)
    rows = rows.select(
        *(c.alias(n) for n, c in own.items()),
        F.col(text_col).alias("text"), F.nullif(declared, F.lit("")).alias("declared"), host.alias("host"),
    ).withColumns(address_parts(F.col("host")))
    scored = stored(_scored(rows, model), "language-scores")
    lettered = scored.where("trigrams > 0")
    total = _sums(lettered, [], size).first()["counts"]
    overall = F.array(*(F.lit((x + 1.0) / (sum(total) + size)) for x in total))

    # How often each language is declared so, given what the texts say.
    told = stored(_sums(lettered.where("declared IS NOT NULL"), ["declared"], size), "declared")
    of_language = _sums(told.withColumnRenamed("counts", "posterior"), [], size).first()["counts"]
    belief = [F.when(F.col("declared") == lang, TRUSTED).otherwise((1 - TRUSTED) / size) for lang in model.languages]
    chances = [F.log((F.col("counts")[i] + DECLARED_ROWS * b) / (of_language[i] + DECLARED_ROWS)) for i, b in enumerate(belief)]
    told = stored(told.select("declared", F.array(*chances).alias("told")), "declared-chances")

    priors = host_priors(lettered, size, overall)
    joined = scored.join(told, "declared", "left").join(priors, "host", "left")
    without_self = F.transform(
        F.arrays_zip(F.col("host_counts").alias("c"), F.col("posterior").alias("p")), lambda z: F.greatest(z["c"] - z["p"], F.lit(0.0))
    )
    prior = F.coalesce(F.when(F.col("trigrams") > 0, _smoothed(without_self, F.col("parent"))), overall)
    joined = joined.withColumn("prior", prior)
    logs = [
        F.col("loglik")[i] + F.coalesce(F.col("told")[i], F.lit(0.0)) + F.log(F.col("prior")[i])
        for i in range(size)
    ]
    joined = joined.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("logs", F.col("top")).cast("int"))
    known = F.col("trigrams") > 0
    language = F.when(known, best).otherwise(UNKNOWN)
    probability = F.when(known, 1 / mass).otherwise(0.0)
    return joined.select(
        *(F.col(n).alias(c) for n, c in zip(own, carried, strict=True)), language.alias("language"), probability.alias("probability"),
        (known & (language != UNKNOWN) & (probability >= least)).alias("accepted"),
    )


def page_evidence(html: Column, url: Column) -> dict[str, Column]:
    """``text``, ``declared`` and ``host`` of web pages."""
    bare = reduce(
        lambda x, pattern: F.regexp_replace(x, pattern, " "),
        [r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"<[^>]*>", r"&#?\w+;"], html,
    )
    return {
        "text": bare,
        "declared": F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1),
        "host": F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")),
    }
