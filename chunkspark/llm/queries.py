"""Queries of the training-data operators, one per operator, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.packing import pack
    from chunkspark.llm.tokens import tokenizer_path

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.jaccard import linked_components

    return linked_components(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.warc import archive_pages

    found = archive_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.quality_rules import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.secrets import ledger_path, secrets_report

    return secrets_report(_table(spark, sf_dir, "documents"), ledger_path(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.token_counts import token_counts
    from chunkspark.llm.tokens import tokenizer_path

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.exact_dedup import duplicate_groups

    found = duplicate_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.filter_audit import audit, document_masks

    return audit(document_masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.row_patterns import value_swings

    found = value_swings(_table(spark, sf_dir, "clicks"))
    return found.select(F.col("key").alias("client_id"), "match_no", "first_id", "last_id", "n_rows", F.col("sum_measure").alias("sum_cents"), F.sha2("labels", 256).alias("labels_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkspark.llm.toxicity import score_toxicity

    found = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    worst = F.reduce("spans", F.lit(None).cast("struct<start:long,stop:long,score:double>"), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
    out = found.withColumn("worst", worst)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_toxic_sentences"), F.col("worst.start").alias("worst_start"), F.col("worst.stop").alias("worst_stop"))


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_license_scan finds by the phrases alone."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6_quality_rules, and the verdict on them alone."""
    from chunkspark.llm.quality_rules import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), None, without_model=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of the base kinds op7_secret_scan finds."""
    from chunkspark.llm.secrets import secrets_report

    return secrets_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op8_mixing, without its draw."""
    found = op8_mixing(spark, sf_dir)
    return found.select("doc_id", "size", "source_size", (F.round("target", 3) + 0.0).alias("target"))


#: One query for each operator.
QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_ngram_jaccard_join, op4_warc, op5_quality_classifier, op6_quality_rules, op7_secret_scan, op8_mixing, op9_token_counts, op10_exact_dedup, op11_filter_audit, op12_row_patterns, op13_toxicity)}
#: Parts of their results that SQL can express.
PARTS = {f.__name__: f for f in (base_license_scan, base_quality_rules, base_secret_scan, base_mixing)}

_WORD = "[^\\x20\\x09-\\x0D]+"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _places(phrase: str, label: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
    return f"list_transform(list_filter(range(len(w) - {len(words) - 1}), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})"


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SQL = {
    "op3_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)""",
    "base_license_scan": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n_words, list_concat({", ".join(_places(*x) for x in _PHRASES[:2])}, {_places(*_PHRASES[2])}) AS p FROM d)
        SELECT doc_id, n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
            array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels FROM p""",
    "base_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS l FROM documents),
        g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        r AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
        c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "base_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 6)) AS n_assign,
            len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d""",
    "base_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k FROM w),
        l AS (SELECT k, (sum(source_size) OVER () - 3 * sum(source_size) OVER (ORDER BY k) + 3 * source_size) / sum(w) OVER (ORDER BY k DESC) AS level, 3 * source_size / w AS stops FROM o),
        f AS (SELECT max(level) FILTER (k = first) AS level FROM (SELECT *, min(CASE WHEN level <= stops THEN k END) OVER () AS first FROM l))
        SELECT doc_id, size, source_size, round(least(3 * source_size, w * coalesce(level, 1e300)), 3) + 0.0 AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, f""",
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f""",
    "op11_filter_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest([0, 1, 2, 3, 4]) AS x),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), 'string_agg', '') AS filter_order, k AS step, o[k] AS x, 1 << o[k] AS bit, list_sum(list_transform(o[:k], lambda x: 1 << x))::INT AS upto FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS k FROM o)),
        r AS (SELECT part, filter_order, step, any_value(x) AS x, coalesce(sum(n) FILTER (mask & upto = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & upto = bit), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (mask & bit > 0 AND mask & upto <> bit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (mask & upto = bit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & upto = bit), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
    "op12_row_patterns": """
        WITH d AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
        o AS (SELECT *, floor(100 * value + 0.5)::BIGINT AS c, row_number() OVER w AS i, coalesce(ts - lag(ts) OVER w <= INTERVAL 30 MINUTE, false) AS near FROM d
            WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST)),
        f AS (SELECT *, lag(c) OVER w AS b, sum(coalesce(c, 0)) OVER w AS upto FROM o WINDOW w AS (PARTITION BY client_id ORDER BY i)),
        l AS (SELECT *, CASE WHEN near AND kind <> 'error' AND c < b THEN 'D' WHEN near AND kind <> 'error' AND c > b THEN 'U' ELSE '-' END AS letter, coalesce(near AND kind = 'click' AND b IS NOT NULL, false) AS p FROM f),
        t AS (SELECT client_id, string_agg(letter, '' ORDER BY i) AS letters FROM l GROUP BY client_id),
        m AS (SELECT l.*, regexp_extract(substr(letters, (i + 1)::INT), '^(D+U+)+') AS body FROM l JOIN t USING (client_id) WHERE c IS NOT NULL),
        e AS (SELECT m.*, n.c >= m.c AND n.p AS more FROM m LEFT JOIN l n ON n.client_id = m.client_id AND n.i = m.i + length(body) + 1 WHERE body <> ''),
        r AS (SELECT *, 'A' || body || CASE WHEN more THEN 'P' ELSE '' END AS labels FROM e)
        SELECT r.client_id, row_number() OVER (PARTITION BY r.client_id ORDER BY r.i) AS match_no, r.click_id AS first_id, z.click_id AS last_id, length(labels) AS n_rows,
            (z.upto - r.upto + r.c)::BIGINT AS sum_cents, sha256(labels) AS labels_sha256
        FROM r JOIN l z ON z.client_id = r.client_id AND z.i = r.i + length(labels) - 1""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
