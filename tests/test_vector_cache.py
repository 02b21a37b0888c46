from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.operators.embed import embed_texts
from chunkspark.operators.vector_cache import VectorCache
from chunkspark.plans.index import Index

def test_each_text_is_embedded_once(spark, tmp_path):
    config = EmbeddingConfig(dimension=16)
    cache = VectorCache(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "three")], "id long, text string")
    found = {r.id: list(r.embedding) for r in cache.embed(rows, "text", config).collect()}
    assert found == {r.id: list(map(float, embed_texts(r.text or " ", config))) for r in rows.collect()}
    assert cache.table.read().count() == 3 and cache.table.segments.last()[0] == 1
    more = rows.unionByName(spark.createDataFrame([(6, "four"), (7, "three")], rows.schema))
    assert cache.embed(more, "text", config).filter("embedding is null").count() == 0
    assert cache.table.changes(1).count() == 1  # the one text that was new
    assert cache.embed(more, "text", config).columns == ["id", "text", "embedding"] and cache.table.segments.last()[0] == 2
    cache.embed(rows, "text", config, "query")
    cache.embed(rows, "text", EmbeddingConfig(dimension=8))
    assert cache.table.read().groupBy("space").count().count() == 3
    assert cache.embed(rows.limit(0), "text", config).collect() == []


def test_a_changed_function_is_the_only_one_embedded(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    text = "".join(f"def f{i}():\n    return 'words of {i}'\n\n" for i in range(8))
    (src / "a.py").write_text(text)
    config = EmbeddingConfig(dimension=16, cache_path=f"file://{tmp_path}/cache")
    index = Index(spark, f"file://{tmp_path}/state", config)
    assert index.sync(str(src), "code").chunks == 8
    cache = VectorCache(spark, config.cache_path).table
    assert cache.read().count() == 8
    (src / "a.py").write_text(text.replace("words of 5", "other words"))
    assert index.sync(str(src), "code").chunks == 8
    assert cache.read().count() == 9 and cache.changes(1).count() == 1
    plain = Index(spark, f"file://{tmp_path}/plain", EmbeddingConfig(dimension=16))
    plain.sync(str(src), "code")
    vectors = [sorted((r.id, tuple(r.embedding)) for r in x.vectors.read().select("id", "embedding").collect()) for x in (index, plain)]
    assert vectors[0] == vectors[1] and index.vectors.read().filter(F.col("embedding").isNull()).count() == 0
