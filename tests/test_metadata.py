import json

import pytest
from pyspark.sql import functions as F

from chunkspark import schema
from chunkspark.operators import metadata as M

DOCS = [
    {"lang": "en", "n": 1, "ok": True}, {"lang": "en", "n": 2}, {"lang": "de", "n": 3}, {"lang": None, "n": -4}, {"n": 5}, {},
    {"lang": "fr", "n": 2, "ok": False, "odd key": "x"}, {"lang": "en", "n": 10**15, "deep": {"a": 1}}, None,
]


def rows(spark, docs, first=0):
    return spark.createDataFrame([(str(first + i), [float(i), 1.0], f"c{first + i}", None if d is None else d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], schema.VECTOR)


def ids(df):
    return sorted(int(r.id) for r in df.select("id").collect())


def folder(tmp_path):
    return f"file://{tmp_path}/t"


def test_frequent_keys(spark):
    found = M.frequent_keys(rows(spark, DOCS), share=0.2)
    assert found == {"n": "long", "lang": "string", "ok": "string"}
    assert M.frequent_keys(rows(spark, DOCS), most=1) == {"n": "long"} and M.frequent_keys(rows(spark, [])) == {}
    assert M.frequent_keys(rows(spark, [{"a": "07"}, {"a": 7}])) == {"a": "string"}
    assert M.frequent_keys(rows(spark, [None, "no json", "[1]"])) == {}


@pytest.mark.parametrize("shred", [{}, {"n": "long", "lang": "string"}, {"ok": "string", "n": "string"}])
def test_filters_equal_those_on_json(spark, tmp_path, shred):
    t = M.MetadataTable(spark, folder(tmp_path), shred)
    assert t.where({"n": 1}).collect() == []
    t.upsert(rows(spark, DOCS))
    t.upsert(rows(spark, [{"lang": "en", "n": "007"}, {"lang": "en", "n": "x"}, "no json", {"n": 2, "odd key": "x"}], 100))
    everything = DOCS + [{"lang": "en", "n": "007"}, {"lang": "en", "n": "x"}, None, {"n": 2, "odd key": "x"}]
    place = [*range(len(DOCS)), 100, 101, 102, 103]

    def want(equal):
        def has(d):
            return d is not None and all(d.get(k) is not None and (json.dumps(d[k]) if not isinstance(d[k], str) else d[k]) in [json.dumps(x) if not isinstance(x, str) else x for x in (v if isinstance(v, list) else [v])] for k, v in equal.items())

        return [i for i, d in zip(place, everything, strict=True) if has(d)]

    for equal in ({"n": 2}, {"n": "2"}, {"n": "007"}, {"n": 7}, {"n": [1, 3, -4]}, {"lang": "en"}, {"lang": "en", "n": 2}, {"ok": True}, {"ok": False, "n": 2}, {"n": 10**15}, {"n": 10**30}, {"lang": "none"}, {"odd key": "x"}, {"n": []}):
        assert ids(t.where(equal)) == want(equal), equal
    with pytest.raises(ValueError, match="quotation"):
        t.where({"a'": 1})


def test_replaced_and_deleted_rows_do_not_match_though_their_segments_are_read_alone(spark, tmp_path):
    t = M.MetadataTable(spark, folder(tmp_path), {"n": "long"})
    t.upsert(rows(spark, [{"n": 1}, {"n": 1}, {"n": 1}]))
    t.upsert(rows(spark, [{"n": 2}]))  # replaces 0
    t.delete(spark.createDataFrame([("1",)], "id string"))
    assert ids(t.where({"n": 1})) == [2] and ids(t.where({"n": 2})) == [0] and ids(t.read()) == [0, 2]
    again = M.MetadataTable(spark, folder(tmp_path), {"other": "string"})
    assert again.segments.kinds == {"n": "long"} and ids(again.where({"n": 2})) == [0]
    t.replace(rows(spark, [{"n": 9}]))
    assert ids(t.where({"n": 9})) == [0] and ids(t.where({"n": 2})) == []


def files(df):
    return len(df.inputFiles())


def test_files_that_cannot_match_are_not_opened(spark, tmp_path):
    t = M.MetadataTable(spark, folder(tmp_path), {"n": "long", "lang": "string"})
    t.upsert(rows(spark, [{"n": i, "lang": "big"} for i in range(1500)]))  # more values than a list holds
    for i, lang in enumerate(("en", "de")):
        t.upsert(rows(spark, [{"n": 5000 + i, "lang": lang}], 2000 + i))
    assert [s["index"]["n"]["values"] for s in t.segments.last()[1]] == [None, [5000], [5001]]
    total = files(t.read())

    def segments(equal):
        return {f.split("/")[-3] for f in t.where(equal).inputFiles() if f.split("/")[-2] == "rows"}

    names = [s["name"] for s in t.segments.last()[1]]
    assert segments({"n": 7}) == {names[0]} and segments({"n": 5000}) == {names[1]} and segments({"lang": "de"}) == {names[2]}
    assert segments({"lang": "de", "n": 5000}) == set() and segments({"n": 1600}) == set() and segments({"lang": ["de", "en"]}) == set(names[1:])
    assert files(t.where({"lang": "de"})) < total
    plan = t.where({"n": 7})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(meta_n,7)" in plan or "In(meta_n, [7])" in plan


def test_bloom_filters_are_written(spark, tmp_path):
    import pyarrow.parquet as pq

    t = M.MetadataTable(spark, folder(tmp_path), {"n": "long"})
    t.upsert(rows(spark, [{"n": 2 * i} for i in range(3000)]))
    data = [p for p in (tmp_path / "t").glob("s-*/rows/*.parquet") if pq.ParquetFile(p).metadata.num_rows]
    assert data and all("meta_n" in pq.ParquetFile(p).schema.names for p in data)
    # an odd number lies between the ends, so the bloom filter alone can spare the row groups
    scanned = t.segments.read("rows", t.segments.last()[1], lambda s: F.col("meta_n") == 2001)
    assert scanned.collect() == []
    nodes, read = [scanned._jdf.queryExecution().executedPlan()], None
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            read = node.metrics().apply("numOutputRows").value()
        nodes += [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.children().apply(i) for i in range(node.children().size())]
    assert read == 0


def test_merged_segments_are_indexed_anew(spark, tmp_path):
    t = M.MetadataTable(spark, folder(tmp_path), {"n": "long"})
    for i in range(5):
        t.upsert(rows(spark, [{"n": i}], i))
    last = t.segments.last()[1]
    assert len(last) < 5 and sorted(v for s in last for v in s["index"]["n"]["values"]) == list(range(5))
    assert [ids(t.where({"n": i})) for i in range(6)] == [[0], [1], [2], [3], [4], []]


def test_search_filters_before_the_cut(spark, tmp_path):
    t = M.MetadataTable(spark, folder(tmp_path), {"lang": "string"})
    t.upsert(rows(spark, [{"lang": "en" if i % 4 == 3 else "de"} for i in range(40)]))
    assert [r.id for r in t.search([0.0, 1.0], 3, equal={"lang": "en"}).collect()] == ["3", "7", "11"]
    assert [r.id for r in t.search([0.0, 1.0], 2).collect()] == ["0", "1"]
