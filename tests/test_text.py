"""Titles, citations, chunks and times on hand-made edge rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C


def value(spark, expression_of, raw):
    df = spark.createDataFrame([(raw,)], "v string")
    return df.select(expression_of(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw", ["", " ", "a", "  a b\t", " x　", "\r\ny\x1c", " ", "é ü ", "\x85z"]
)
def test_strip_is_python_strip(spark, raw):
    assert value(spark, X.strip, raw) == raw.strip()
    assert value(spark, X.strip_short, raw) == raw.strip()


@pytest.mark.parametrize(
    "raw,wanted",
    [("x" * 50, "x" * 50), ("x" * 51, "x" * 50 + "…"), ("", ""), ("😀" * 51, "😀" * 50 + "…")],
)
def test_title(spark, raw, wanted):
    assert value(spark, X.title_of, raw) == wanted


@pytest.mark.parametrize("raw,wanted", [(None, "Untitled Chat"), ("", "Untitled Chat"),
                                        ("t" * 40, "t" * 38), (" ", " ")])
def test_display_title(spark, raw, wanted):
    assert value(spark, X.display_title, raw) == wanted


@pytest.mark.parametrize(
    "raw,wanted",
    [
        ("2024-03-05 21:07:09.123456", "Mar 05, 09:07 PM"),
        ("2024-03-05T00:00:00Z", "Mar 05, 12:00 AM"),
        ("2024-03-05T12:30:00+05:30", "Mar 05, 12:30 PM"),
        ("2024-03-05", "Mar 05, 12:00 AM"),
        ("2024-13-05 21:07:09", "2024-13-05 21:07"),
        ("2024-03-05T21", "Mar 05, 09:00 PM"),
        ("2024-03-05T21:07", "Mar 05, 09:07 PM"),
        ("20240305T210709", "Mar 05, 09:07 PM"),
        ("20240305", "Mar 05, 12:00 AM"),
        ("20240305T2107Z", "Mar 05, 09:07 PM"),
        ("2024-03-05T21:07:09.123456789", "Mar 05, 09:07 PM"),
        ("2024-03-05T21:07:09,5+0530", "Mar 05, 09:07 PM"),
        ("2024-03-05T21:07:09-05", "Mar 05, 09:07 PM"),
        ("2024-03-05T21:07:09+05:30:15", "Mar 05, 09:07 PM"),
        ("2024-03-05Z", "Mar 05, 12:00 AM"),
        ("2024-0305T21:07", "2024-0305T21:07"),
        ("2024-03-05T21:0709", "2024-03-05T21:07"),
        ("2024-03-05T24:01", "2024-03-05T24:01"),
        ("2024-03-05T21:60", "2024-03-05T21:60"),
        ("2024-03-05T21:07:09.", "2024-03-05T21:07"),
        ("2024-03-05T21:07:09+0", "2024-03-05T21:07"),
        ("2024-03-05T21:07\n", "2024-03-05T21:07"),
        ("2023-02-29", "2023-02-29"),
        ("2024", "2024"),
        ("yesterday at noon or so", "yesterday at noo"),
        ("None", "None"),
    ],
)
def test_activity_time(spark, raw, wanted):
    assert value(spark, X.activity_time, raw) == wanted


@pytest.mark.parametrize("raw,wanted", [("bk101.pdf", "bk101"), ("a.pdf.pdf", "a"),
                                        ("x.PDF", "x.PDF"), ("n", "n")])
def test_chapter(spark, raw, wanted):
    assert value(spark, X.chapter_name, raw) == wanted


@pytest.mark.parametrize("raw,wanted", [("bk107", "07"), ("7", "7"), ("", "")])
def test_chapter_number(spark, raw, wanted):
    assert value(spark, X.chapter_number, raw) == wanted


@pytest.mark.parametrize("page,pages,wanted", [(1, 5, 0), (0, 5, 0), (9, 5, 4), (-3, 1, 0)])
def test_page_index(spark, page, pages, wanted):
    df = spark.createDataFrame([(page, pages)], "a int, b int")
    assert df.select(X.page_index(F.col("a"), F.col("b")).alias("r")).first().r == wanted


def python_chunks(text):
    text = text.replace("\n", " ").strip()
    return [text[i : i + 1000] for i in range(0, len(text), 800)]


@pytest.fixture(scope="module")
def pages(spark):
    sizes = [0, 1, 799, 800, 801, 1000, 1001, 1600, 1601, 1700, 33000]
    texts = ["".join(chr(97 + i % 26) for i in range(n)) for n in sizes]
    texts += [" \n ", "x\ny", "a" * 799 + "😀" + "b" * 900, None]
    rows = [(i, f"bk1{i % 3:02d}.pdf", i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "document_key long, file_name string, page_number int, text string"
    )


def test_chunks_are_the_overlapping_windows(pages):
    got = {}
    for r in C.chunk_pages(pages).collect():
        got.setdefault(r.page_number, []).append(r)
    for page in pages.collect():
        wanted = python_chunks(page.text or "")
        chunks = got.pop(page.page_number, [])
        assert sorted(c.text_content for c in chunks) == sorted(wanted)
        assert all(c.chapter == page.file_name[:-4] for c in chunks)
        assert all((c.class_level, c.language) == (8, "English") for c in chunks)
    assert not got


def test_chunk_ids_are_unique_and_repeatable(pages):
    first = [r.chunk_id for r in C.chunk_pages(pages).collect()]
    again = [r.chunk_id for r in C.chunk_pages(pages.repartition(3)).collect()]
    assert len(set(first)) == len(first) and set(first) == set(again)


def test_counts_without_cutting(pages):
    counted = {r.chapter: (r.pages, r.chunks) for r in C.chunk_counts(pages).collect()}
    cut = C.chunk_pages(pages).groupBy("chapter").agg(
        F.countDistinct("page_number").alias("p"), F.count("*").alias("c")
    )
    assert counted == {r.chapter: (r.p, r.c) for r in cut.collect()}


def test_chunking_needs_no_shuffle_and_reads_few_columns(spark):
    from lectern.plans import inputs

    df = inputs.chunks(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
