"""The stages one by one and together."""

import random

import corpus_pipeline
import pytest

from lectern.llm import stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = ["the", "of", "and", "house", "with", "thing", "other", "water"], ["der", "und", "nicht", "auch", "über", "schön", "zeit", "wasser"]


def rows(seed=1, n=120):
    chance = random.Random(seed)
    out = []
    for i in range(n):
        lang, vocabulary = chance.choice([("en", EN), ("de", DE)])
        text = "\n".join(" ".join(chance.choice(vocabulary) + chance.choice(vocabulary) for _ in range(chance.randint(5, 30))) for _ in range(chance.randint(1, 5)))
        out.append((i, text, lang, chance.choice("aaab") if i % 17 else None, len(text)))
    return out


def run_stages(spark, docs, upto=len(corpus_pipeline.STAGES)):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), schema=stage(spark, docs, "").schema)
    return docs


def test_names_and_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        stages.known_language, stages.one_of_each_group, stages.without_repeated_passages, stages.mixed_sources, stages.packed_sequences,
    ]


def test_language_stage_rejects_texts_without_letters(spark):
    docs = spark.createDataFrame([*rows(), (500, None, "en", "a", 0), (501, "12 34 !!", "en", None, 8), (502, "", None, None, 0), (None, "the water and other", "en", "a", 19)], SCHEMA)
    got = stages.known_language(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [*((False, i) for i in range(120)), (True, 0)]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    base = rows()
    copies = [(1000 + i, *r[1:]) for i, r in enumerate(base[:30])]
    twice = base[40:44]
    got = stages.one_of_each_group(spark, spark.createDataFrame([*base, *copies, *twice, (None, None, None, None, None)], SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(120)) and sum(r.doc_id is None for r in got) == 1


def test_passage_stage_counts_characters_anew(spark):
    line = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a\n{line}", "en", "a", 0), (2, f"b\n{line}", "en", "a", 0), (3, line, "en", "a", 0), (4, None, "en", "a", None)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.without_repeated_passages(spark, docs, "").collect()}
    assert got == {1: (f"a\n{line}", len(line) + 2), 2: ("b\n", 2), 4: (None, None)}


def test_mixing_stage_repeats_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = stages.mixed_sources(spark, docs, "").toPandas()
    taken = stages.mixing.mixed_documents(docs).toPandas().set_index("doc_id").copies
    assert got.groupby("doc_id").size().to_dict() == taken[taken > 0].to_dict()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_carry_other_columns_and_take_no_rows(spark, stage):
    more = spark.createDataFrame([(*r, "keep", r[0]) for r in rows(n=40)], SCHEMA + ", removed string, id long")
    got = stage(spark, more, "")
    assert got.schema.names == more.schema.names and all(r.removed == "keep" and r.id == r.doc_id for r in got.collect())
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_run_reads_and_writes_every_stage(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and set(got.doc_id) <= set(range(120))
