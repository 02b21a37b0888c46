import io
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from chunkspark import schema, serve
from chunkspark.__main__ import main
from chunkspark.config import ChatConfig, DomainConfig, EmbeddingConfig, LoggingConfig, ModelConfig, SearchQuery, StoreConfig, settings
from chunkspark.functions.display import shown
from chunkspark.operators import generate
from chunkspark.operators.chat import model_of
from chunkspark.operators.embed import embed_texts
from chunkspark.operators.vectors import STORES, JdbcStore, MemoryStore, VectorStore, open_store, with_ids
from chunkspark.plans.index import Index
from chunkspark.plans.processors import MIXINS, create_processor
from chunkspark.streaming.jobs import send_events


def rows(spark, *r):
    return spark.createDataFrame(list(r), schema.VECTOR)


ROWS = [("a", [1.0, 0.0], "one", '{"content": "ONE", "f": 1}'), ("b", [0.0, 2.0], "two", '{"f": 2}'), ("c", [3.0, 3.0], "three", "bad")]


@pytest.fixture(params=["parquet", "chroma", "testing", "jdbc"])
def any_store(request, spark, tmp_path):
    if request.param == "jdbc":
        own = JdbcStore(spark, f"jdbc:derby:memory:{tmp_path.name};create=true", "vectors", vector_type="varchar(4000)", text_type="varchar(4000)", options={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
        own.run(own.create_sql())
        return VectorStore(own, "l2", True, True, True, "ordinal")
    return open_store(spark, StoreConfig(request.param, f"file://{tmp_path}", "t"))


def test_stores_agree(any_store, spark):
    s = any_store
    s.add(rows(spark, *ROWS))
    assert [r.id for r in s.query([1.0, 0.1], 2).collect()] == (["a", "c"] if s.metric == "cosine" else ["a", "b"])
    s.update(rows(spark, ("b", [9.0, 9.0], "new", "{}")))
    with pytest.raises(KeyError):
        s.update(rows(spark, ("zz", [9.0, 9.0], "new", "{}")))
    s.delete(spark.createDataFrame([("c",), ("none",)], "id string"))
    assert {(r.id, r.document) for r in s.all().collect()} == {("a", "one"), ("b", "new")}
    assert [(r.id, r.score) for r in s.get(spark.createDataFrame([("a",)], "id string")).collect()] == [("a", s.get_score)]
    s.add(spark.createDataFrame([("no id", [5.0, 5.0], "{}")], "content string, embedding array<float>, doc_metadata string"))
    assert s.all().count() == 3
    assert s.can("vector") and s.search(SearchQuery([1.0, 0.0], 1, None)).first().id == "a"
    s.close()


def test_thresholds_filters_and_content(spark):
    s = VectorStore(MemoryStore(spark), "l2", prefilter=False, thresholds=True, content_field="content", abilities=set())
    s.add(rows(spark, *ROWS))
    assert [r.document for r in s.query([1.0, 0.0], 3, threshold=0.5).collect()] == ["ONE"]
    assert s.query([1.0, 0.0], 1, where=F.col("id") == "b").count() == 0
    s.prefilter = True
    assert [r.id for r in s.query([1.0, 0.0], 1, where=F.col("id") == "b").collect()] == ["b"]
    with pytest.raises(ValueError, match="can't search"):
        s.search(SearchQuery([1.0, 0.0]))
    with pytest.raises(ValueError, match="no search method"):
        s.can("hybrid")


def test_memory_store_fails_on_demand(spark):
    broken = STORES.get("testing")(spark, StoreConfig("testing", options={"fail_on": ["upsert"]}))
    with pytest.raises(RuntimeError, match="upsert failed"):
        broken.add(rows(spark, *ROWS))
    assert broken.all().count() == 0


def test_stores_are_opened_once(spark, tmp_path):
    c = StoreConfig("parquet", f"file://{tmp_path}", "once")
    assert open_store(spark, c) is open_store(spark, c)
    with pytest.raises(KeyError, match="no vector store"):
        open_store(spark, StoreConfig("none"))


def test_pgvector_statements(spark):
    s = JdbcStore(spark, "jdbc:postgresql://h/db", "chunks", "vector(768)")
    assert s.create_sql() == "CREATE TABLE chunks (id varchar(256) NOT NULL PRIMARY KEY, embedding vector(768), content text, doc_metadata text)"
    assert s.index_sql("cosine", replace=True) == ["DROP INDEX IF EXISTS chunks_cosine_index", "CREATE INDEX IF NOT EXISTS chunks_cosine_index ON chunks USING hnsw (embedding vector_cosine_ops)"]
    assert "CAST(embedding AS vector(768))" in s._insert_sql("staged")


def test_ids_when_none_are_given(spark):
    df = spark.range(0, 50, 1, 7).select(F.lit("x").alias("content"))
    assert sorted(int(r.id) for r in with_ids(df, "ordinal").collect()) == list(range(50))
    assert len({r.id for r in with_ids(df).collect()}) == 50


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def alpha():\n    return 'apple pear'\n\ndef beta():\n    return 'river stone'\n")
    return src


def test_processors(spark, tree, tmp_path):
    config = EmbeddingConfig(dimension=16)
    domain = DomainConfig("code", "Code", "codebase", meta={"directory_path": str(tree)}, processor={"languages": {"python": {"max_file_size": 10}}})
    index = Index(spark, f"file://{tmp_path}/state", config)
    assert index.run(create_processor(domain, config)).chunks == 0
    domain.processor = {}
    (tree / "a.py").write_text((tree / "a.py").read_text() + "x = 1\n")
    assert index.run(create_processor(domain, config)).chunks == 2
    assert [(r.name, json.loads(r.meta)) for r in index.domains.read().collect()] == [("Code", {"directory_path": str(tree)})]

    @MIXINS.register("Words")
    class Words:
        def __init__(self, context):
            self.context = context

        def parse(self, assets):
            words = assets.select("id", "domain_id", F.posexplode(F.split(F.col("content").cast("string"), r"\s+")).alias("i", "content"))
            return words.select(F.concat("id", F.lit("#"), "i").alias("id"), F.col("id").alias("asset_id"), "domain_id", "content", F.lit("{}").alias("meta"))

    domain.mixins = {"parser": "Words"}
    (tree / "a.py").write_text("one two three")
    assert index.run(create_processor(domain, config)).chunks == 3
    for change, said in (({"mixins": {"source": "Words"}}, "no source"), ({"mixins": {"parser": "None"}}, "no mixin"), ({"meta": {"where": 1}}, "where"), ({"domain_type": "x"}, "no domain type")):
        with pytest.raises(ValueError, match=said):
            create_processor(DomainConfig(**({"id": "d", "name": "d", "domain_type": "codebase", "meta": {"directory_path": "."}} | change)))


@pytest.fixture
def service(spark, tree, tmp_path):
    index = Index(spark, f"file://{tmp_path}/state", EmbeddingConfig(dimension=64))
    processor = create_processor(DomainConfig("code", "Code", "codebase", meta={"directory_path": str(tree)}), index.config)
    return serve.Service(index, ChatConfig(ModelConfig(settings={"answer": "so it is"})), [processor])


def test_tools(service):
    ask = {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search_code", "arguments": {"query": "river stone", "top_k": 1}}}
    assert serve.handle(service, ask)["result"] == {"content": []}
    service.parse().join()
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, ask, {"id": 4, "method": "tools/call", "params": {"name": "x"}}, {"id": 5, "method": "y"}, {"id": 6, "method": "tools/call", "params": {"name": "search_code"}}]
    out = io.StringIO()
    serve.serve_tools(service, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nnot json\n"), out)
    got = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and got[2]["result"]["tools"][0]["name"] == "search_code"
    assert json.loads(got[3]["result"]["content"][0]["text"])["id"] == "a.py:3-4"
    assert got[4]["error"]["code"] == -32602 and got[5]["error"]["code"] == -32601 and got[6]["result"]["isError"]


def test_background_runs_say_what_became_of_them(service, spark):
    from dataclasses import replace

    good = service.processors[0]

    class Broken:
        def scan(self, spark):
            raise OSError("the disk is gone")

    service.processors = [replace(good, domain=DomainConfig("bad", "Bad", "codebase", meta=good.domain.meta), source=Broken()), good]
    assert service.parsed == {}
    service.parse().join()
    assert service.parsed[good.domain.id] == {"status": "done"}
    assert service.parsed["bad"]["status"] == "failed" and "disk is gone" in service.parsed["bad"]["error"]


def test_questions_are_asked_of_all_stores_at_once(spark):
    from chunkspark.operators.embed import embedding
    from chunkspark.plans.retrieve import retrieve

    config = EmbeddingConfig(dimension=32)
    words = ["apple pie", "river stone", "blue sky", "old river"]
    made = {d: spark.createDataFrame([(f"{i}", w + d) for i, w in enumerate(words)], "id string, content string").withColumn("embedding", embedding(F.col("content"), config)) for d in ("", " b")}
    asked = spark.createDataFrame([(1, "river stone"), (2, "apple pie b")], "qid int, question string")
    found = retrieve(asked, made, 2, config=config).collect()
    assert len(found) == 8 and {(r.qid, r.domain, r.document) for r in found if r.rk == 1} == {(1, "", "river stone"), (1, " b", "river stone b"), (2, "", "apple pie"), (2, " b", "apple pie b")}
    assert all(abs(r.score - 1) < 1e-6 for r in found if (r.qid, r.domain, r.rk) in ((1, "", 1), (2, " b", 1)))


def test_http(service):
    server = serve.http_server(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def get(path, data=None):
        try:
            with urllib.request.urlopen(f"{base}{path}", data=data, timeout=120) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert get("/health") == (200, '{"status": "ok"}') and get("/none")[0] == 404 and get("/search")[0] == 400
        assert get("/parse", b"")[0] == 202
        service.parse().join()
        assert {x["status"] for x in json.loads(get("/parse")[1]).values()} == {"done"}
        assert json.loads(get("/search?query=apple&top_k=1")[1])[0]["id"] == "a.py:0-1"
        events = [json.loads(x.split("data: ")[1]) for x in get("/chat?question=river+stone")[1].strip().split("\n\n")]
        assert [e["status"] for e in events] == ["STARTING", "RETRIEVING", "ANSWERING", "COMPLETE"] and events[-1]["answer"] == "so it is"
    finally:
        server.shutdown()
        server.server_close()


def test_command_line(spark, tree, tmp_path):
    out = io.StringIO()
    base = ["--state", f"file://{tmp_path}/cli", "--dimension", "32"]
    assert main([*base, "parse"], out) == 2
    assert main([*base, "parse", str(tree), "--output", "json"], out) == 0
    assert json.loads(out.getvalue()) == [{"domain": str(tree), "found": 1, "dirty": 1, "deleted": 0, "chunks": 2}]
    out = io.StringIO()
    assert main([*base, "search", "river stone", "--top-k", "1"], out) == 0 and json.loads(out.getvalue())["id"] == "a.py:3-4"
    out = io.StringIO()
    assert main([*base, "ask", "river"], out) == 0 and out.getvalue().splitlines()[-1] == "No model is connected."
    assert shown(spark.createDataFrame([("a", None)], "x string, y string")) == "x  y\na  N/A"
    with pytest.raises(ValueError, match="no format"):
        shown(spark.range(1), "xml")


def test_generation_in_stages(spark):
    asked = spark.createDataFrame([(1, "a menu"), (2, "boom"), (3, " "), (4, None)], "qid int, description string")

    def model(prompt):
        if "boom" in prompt and "UXML document boom" in prompt:
            raise RuntimeError("no")
        return "boom" if "boom" in prompt else f"<{len(prompt)}>"

    done = generate.generate(asked, model)
    found = {r.qid: r for r in done.collect()}
    assert all(found[1][s] for s in generate.STAGES) and found[1].error is None
    assert found[2].filename == "boom" and found[2].uxml is None and found[2].error == "uxml: no"
    assert found[3].error == found[4].error == "the description is empty"
    events = {}
    for r in generate.stage_events(done, "qid").orderBy("qid", "step").collect():
        events.setdefault(r.qid, []).append(r.status)
    assert events == {1: [*(f"GENERATING_{s.upper()}" for s in generate.STAGES), "COMPLETE"], 2: ["GENERATING_FILENAME", "ERROR"], 3: ["ERROR"], 4: ["ERROR"]}
    said = spark.createDataFrame([(0, "CANCEL: 7"), (1, "a menu"), (2, "  "), (3, '{"description": "x", "chat": {}}'), (4, '{"description": ""}')], "i int, m string")
    assert [r.k for r in said.orderBy("i").select(generate.message_kind(F.col("m")).alias("k")).collect()] == ["cancel", "describe", "empty", "override", "empty"]


def test_events_are_sent_in_order(spark, tmp_path):
    spark.createDataFrame([(q, s, st) for q in (2, 1) for s, st in enumerate(("STARTING", "COMPLETE"))], "qid int, step int, status string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream, sent = spark.readStream.schema("qid int, step int, status string").parquet(f"{tmp_path}/in"), []
    send_events(stream, sent.append, f"{tmp_path}/c").awaitTermination(120)
    assert sent[0] == 'event: starting\ndata: {"qid": 1, "step": 0, "status": "STARTING"}\n\n' and len(sent) == 4


def test_settings_models_and_prompts(tmp_path):
    (tmp_path / "chat.yaml").write_text("title: T\nmodel: {name: m, system_prompt: Be brief.}\n")
    c = settings(ChatConfig, str(tmp_path / "chat.yaml"), {"placeholder": "p"})
    assert (c.title, c.placeholder, c.model.name, c.model.provider, c.analytics.enabled) == ("T", "p", "m", "testing", False)
    with pytest.raises(ValueError, match="has no x"):
        settings(ChatConfig, given={"x": 1})
    assert model_of(c.model)("hi") == "No model is connected."
    plain, asking = EmbeddingConfig(dimension=32), EmbeddingConfig(dimension=32, query_prompt="find code: ")
    assert embed_texts("river", asking) == embed_texts("river", plain, "query") != embed_texts("river", asking, "query")
    with pytest.raises(ValueError, match="no mode"):
        embed_texts("river", plain, "other")
    LoggingConfig(json_lines=True, to_stderr=False, file=str(tmp_path / "log")).apply("chunkspark.test")
    import logging

    logging.getLogger("chunkspark.test").warning("it %s", "works")
    assert json.loads((tmp_path / "log").read_text())["message"] == "it works"
