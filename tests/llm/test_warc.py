"""Archives: what is written is read back, whatever the payloads hold and wherever splits fall."""

import base64
import hashlib
import re
from collections import Counter

import pytest

from lectern.cluster import new_shared_path
from lectern.llm import warc

FAKE = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(rows, least=0):
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        first = largest.get(html or "")
        again = len(payload) >= least and first is not None and i != first and list(r[2] or "" for r in rows).count(html or "") > 1
        out[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    return out


def pages():
    rows = [(i, f"http://x/{i}", "A" * (i * 37 % 900) + (FAKE if i % 5 == 0 else "") + warc.MAGIC * (i % 4) + "Z" * (i * 13 % 50)) for i in range(120)]
    rows += [(400 + i, None, None if i % 2 else "é\r\n\r\nx") for i in range(6)]
    return rows + [(None, "u v\r\nWARC/1.1\r\n", "nul"), (500, "a", "dup"), (500, "a", "dup"), (499, "a", "dup"), (None, "b", "dup"), (600, "c", "long " * 60_000)]


@pytest.mark.parametrize("split", ["700", "5000", "64m"])
def test_round_trip(spark, split):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archived_pages(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)


def test_small_payloads_may_stay_responses(spark):
    rows = [(1, "a", "ab"), (2, "a", "ab"), (3, "b", "abcd"), (4, "b", "abcd")]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=3).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows, 3)


def test_files_parse_one_record_after_the_other(spark, tmp_path):
    rows = pages()
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    (file,) = (tmp_path / "w").glob("part-*")
    data, at, count = file.read_bytes(), 0, 0
    while at < len(data):
        assert data.startswith(warc.MAGIC.encode(), at)
        end = data.index(b"\r\n\r\n", at) + 4
        at = end + int(re.search(rb"Content-Length: (\d+)", data[at:end])[1]) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
        count += 1
    assert count == len(rows)


def test_a_broken_header_ends_its_file(spark):
    path = new_shared_path(spark, "broken")
    good = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r"
    broken = f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: x\r\n\r\nhi\r\n\r"
    spark.createDataFrame([(good,), (broken,), (good,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    assert [r.record_id for r in warc.read_archives(spark, path).collect()] == ["urn:page:1"]


def test_no_rows(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
