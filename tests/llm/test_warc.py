import hashlib
import io
import random

import pytest

from chunkspark.llm import warc
from chunkspark.llm.shared import new_folder


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        ref = first.get(html or "")
        shared = len(body) >= 100 and ref is not None and ref != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if shared else "response", ref if shared else None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    bodies = ["é" * 50, "é" * 49 + "a", "x" * 99, "x" * 100, "<p>\r\n\r\nWARC/1.1\r\n" * 30, "", None, "big " * 200_000]
    urls = ["http://a.example.com/x?q=1#f", "https://www.B.example.com:81/é ü", None, "not a url", "http://[bad/", "http://a.example.com/\r\nX: y"]
    return [(i, rng.choice(urls), rng.choice(bodies[:-1]) if i % 60 else bodies[-1]) for i in range(300)] + [(7, "u", "x" * 100), (None, "u", "x" * 100), (400, "u", "only one of these " * 10), (400, "u", "only one of these " * 10)]


def test_round_trip(spark, rows):
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found) == expected(rows)
    keys = [warc._order(tuple(r)) for r in found]
    assert keys == sorted(keys) and len(set(keys)) == len(rows)


def test_ranges_and_more_runs_than_a_tree_merges(spark, rows):
    pages = spark.createDataFrame(rows[:150], "page_id long, url string, html string")
    archives = warc.write_archives(pages, new_folder(spark, "t"), roll_at=1)
    assert archives.count() > warc.FAN_IN  # and 2 runs a part are fewer than the session's tasks, so keys come in parts
    assert spark.sparkContext.defaultParallelism > 2
    for most in (2, 100, 1000):
        found = warc.read_archives(archives, new_folder(spark, "t"), per_range=20, most_runs=most)
        assert found.rdd.getNumPartitions() > 3
        keys = [warc._order(tuple(r)) for r in found.collect()]
        assert keys == sorted(keys) and len(set(keys)) == 150


def test_archives_end_by_records_too(spark):
    pages = spark.createDataFrame([(i, "u", "") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    assert warc.write_archives(pages, new_folder(spark, "t"), roll_records=4).count() >= 5


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8, 13):
        sources = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(s) for s in sources], key=lambda x: (x,))) == sorted(x for s in sources for x in s)


def test_records_read_from_small_pieces():
    data = [warc._zipped(warc.record(i, f"http://h/{i}", b"p" * i, "d", None if i % 2 else 1)) for i in range(40)]

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    found = list(warc.read_records(Slow(b"".join(data))))
    assert [(o, n) for o, n, _, _ in found] == [(sum(map(len, data[:i])), len(data[i])) for i in range(40)]
    assert [warc.page_of(h["WARC-Record-ID"]) for _, _, h, _ in found] == list(range(40))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(b"".join(data)[:-3])))


def test_url_keys():
    assert warc.url_key("https://www.B.Example.com:81/A?q=1#f") == "com,example,b:81)/a?q=1"
    assert warc.url_key("http://h") == "h)/" and warc.url_key("") == ")/"


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
