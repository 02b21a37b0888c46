import corpus_pipeline
from chunkspark.llm import queries
from chunkspark.llm.shared import materialise


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.filter("start = 0").count() == counts[4]


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs, no_labels, tmp_path):
    """What each stage leaves of the odd rows: ids, None for the row without one."""
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def left(name):
        return sorted((r.doc_id for r in stages[name](spark, odd_docs, str(tmp_path)).select("doc_id").collect()), key=str)

    everyone = [*range(12), 12, 12, None]
    assert left("quality_rules") == []  # too short, or of one word
    # 0 and 1 are null and empty, 8 and 9 equal 10 but for case, 12 is there twice
    assert left("exact_dedup") == sorted([*range(1, 8), 10, 11, 12, None], key=str)
    assert left("ngram_jaccard_join") == sorted([i for i in everyone if i not in (9, 10)], key=str)
    mixed = left("source_mixing")
    assert set(mixed) <= set(everyone) and max(mixed.count(i) for i in mixed) <= 6
    pieces = stages["packing"](spark, odd_docs, str(tmp_path))
    assert pieces.filter("start = 0").count() == len(everyone)
    for name, stage in stages.items():
        assert stage(spark, no_docs, str(tmp_path)).collect() == [], name


def test_long_near_copies_and_clashing_columns(spark):
    words = [f"w{i % 997}x{i}" for i in range(60_000)]
    rows = [(i, " ".join([*words[: 1000 * i], "changed", *words[1000 * i + 1 :]]), "s", 1, 2, 3) for i in range(1, 4)]
    rows += [(9, "alone " + " ".join(words[::-1]), "s", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_copy int, mix_copy int, _salt int")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["ngram_jaccard_join"](spark, df, "")
    assert near.columns == df.columns and sorted(r.doc_id for r in near.collect()) == [1, 9]
    mixed = stages["source_mixing"](spark, df, "")
    assert mixed.columns == df.columns and mixed.count() == 4


def test_names_of_queries():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == ["op1_packing", "op2_license_scan", "op3_ngram_jaccard_join", "op4_warc", "op5_quality_classifier", "op6_quality_rules", "op7_secret_scan", "op8_mixing", "op9_token_counts", "op10_exact_dedup"]
    assert set(queries.SQL) <= set(queries.QUERIES | queries.PARTS)


def test_sql_equals_query(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def rows(pdf):
        # a column of whole numbers with nulls may come as floats
        plain = pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)
        return sorted(str(tuple(int(x) if isinstance(x, float) and x.is_integer() else x for x in r)) for r in plain)

    for name, sql in queries.SQL.items():
        found = (queries.QUERIES | queries.PARTS)[name](spark, sf_dir).toPandas()
        want = con.execute(sql).fetchdf()[list(found.columns)]
        assert rows(found) == rows(want)
