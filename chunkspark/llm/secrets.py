"""Secrets in texts through an incremental blob ledger. DataFrame and SQL functions only.

Every version of every document is addressed by its content. The ledger holds what each version
of the rules found in each blob, so a run scans only pairs of blob and rule version that it lacks,
once each however many paths share the blob, and joins the findings back to all paths. It is a
table in the shared folder that runs append to; two runs that scan one blob enter the same.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkspark.llm.shared import hashed_side, lookup_join, materialise, shared_root


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has `least` characters or more.

    `hint`, a literal or a cheaper pattern, must occur in any text that has a match. Neither may
    run on from each of many starts, which is the square of a long text's length.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    literal: bool = False


#: The base rules come first, in this order.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA", True),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, "-----BEGIN ", True),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 0, "gh[opsu]_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox", True),
    Rule("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 0, 0, "eyJ", True),
)
SPAN = "array<struct<start:int,kind:int,stop:int>>"


#: Number of the code that turns rules into spans. It must grow when `rule_steps` or `_spans` give other spans
#: for the same rules, so that what older code entered in a ledger is not taken for this code's findings.
ENGINE = 2


def rule_version(rules=RULES, engine: int = ENGINE) -> str:
    return hashlib.sha256(repr((engine, rules)).encode()).hexdigest()[:16]


def rule_steps(text: Column, rule: Rule) -> Column:
    """Lengths in code points of each match, its group, and what lies before it: array of (gap, hit, core).

    Matches start where the gaps and matches before them end. The last entry, after the last match,
    has no hit. Texts without the hint have no entries.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), group.alias("core"))
    sizes = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["core"]).alias("core")))
    hinted = F.contains(text, F.lit(rule.hint)) if rule.literal else text.rlike(rule.hint)
    return F.when(hinted, sizes).otherwise(F.array().cast("array<struct<gap:int,hit:int,core:int>>"))


def _spans(steps: DataFrame, rules) -> DataFrame:
    """blob and sorted spans, of rows blob and steps, an array with the steps of each rule; blobs without spans are left out."""
    rows = steps.select("blob", F.posexplode("steps").alias("kind", "own")).select("blob", "kind", F.posexplode("own").alias("i", "x"))
    upto = F.sum(F.col("x.gap") + F.coalesce("x.hit", F.lit(0))).over(Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    ended = rows.withColumn("stop", upto.cast("int")).filter(F.col("x.hit").isNotNull() & (F.col("x.core") >= least))
    span = F.struct((F.col("stop") - F.col("x.hit")).alias("start"), "kind", "stop")
    return ended.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))


def scan_blobs(versions: DataFrame, seen: DataFrame | None, text: str = "text", path: str = "doc_id", rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, new ledger rows, blobs) for all rows of `versions`.

    `paths` has path and blob of every row, `blobs` the number of rows of each, and the ledger rows
    (blob, rule_version, spans) are those that `seen` lacks; a blob without findings is in the
    ledger too, with no spans.
    """
    version = rule_version(rules)
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(path).cast("string"), F.lit("-"))
    rows = versions.select(F.col(path).alias("path"), key.alias("key"), whole.alias("text"), F.sha2(whole, 256).alias("blob"))
    paths = materialise(rows.drop("text"), "paths")
    blobs = materialise(paths.groupBy("blob").agg(F.count("*").alias("n_paths"), F.min("key").alias("key")), "blobs")
    todo = blobs.select("blob", "key")
    if seen is not None:
        todo = todo.join(seen.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    todo = materialise(todo, "todo")
    unseen = rows.select("key", "text", "blob").join(hashed_side(todo, todo.count()), ["key", "blob"], "left_semi")
    scanned = unseen.select("blob", F.array(*(rule_steps(F.col("text"), r) for r in rules)).alias("steps"))
    hit = scanned.filter(F.exists("steps", lambda x: F.size(x) > 1))
    # rows repeated under one path scan alike
    steps = materialise(hit.groupBy("blob").agg(F.any_value("steps").alias("steps")), "steps")
    ledger = todo.select("blob").join(_spans(steps, rules), "blob", "left")
    none = F.array().cast(SPAN)
    return paths, materialise(ledger.select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", none).alias("spans")), "ledger"), blobs


def find_secrets(versions: DataFrame, seen: DataFrame | None = None, text: str = "text", path: str = "doc_id", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows). Findings have one row per row of `versions`: path, blob, spans.

    Spans are sorted by start, then by the order of the rules. Null texts count as empty; null
    paths and repeated rows are reported each for itself; an empty table gives no rows.
    """
    paths, new, blobs = scan_blobs(versions, seen, text, path, rules)
    ledger = new
    if seen is not None:
        known = seen.filter(F.col("rule_version") == rule_version(rules)).select(new.columns)
        ledger = new.unionByName(known.join(blobs.select("blob"), "blob", "left_semi"))
    found = blobs.select("blob", "n_paths").join(ledger.filter(F.size("spans") > 0).select("blob", "spans"), "blob", "left")
    joined = lookup_join(paths, found, ["blob"], "n_paths", paths.count(), F.struct("key"), wide=True)
    return joined.select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), new


LEDGER = f"blob string, spans {SPAN}, rule_version string"


def ledger_path(spark: SparkSession, corpus: str) -> str:
    """Where the ledger of all runs over a corpus is kept, in the shared folder."""
    return f"{shared_root(spark)}/chunkspark-secrets-ledger/{hashlib.sha256(corpus.encode()).hexdigest()[:16]}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """Ledger rows entered so far, one for each blob and rule version; None before the first run."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.groupBy("blob", "rule_version").agg(F.max("spans").alias("spans"))


def enter(new: DataFrame, path: str) -> None:
    """Append ledger rows. Each stands for itself, so what a broken run leaves is as good."""
    new.select("blob", "spans", "rule_version").write.mode("append").partitionBy("rule_version").parquet(path)


def compact_ledger(spark: SparkSession, path: str) -> None:
    """Rewrite a ledger as few files, without repeated entries and those of other rules or older code. For times without runs."""
    rows = read_ledger(spark, path)
    if rows is None:
        return
    merged = f"{path}-{uuid.uuid4().hex}"
    enter(rows.filter(F.col("rule_version") == rule_version()).hint("rebalance"), merged)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, merged))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(old, True)
    system.rename(new, old)


def spans_text(spans: Column, rules=RULES) -> Column:
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def secrets_report(versions: DataFrame, ledger: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `versions`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob.

    With the path of a ledger, blobs that it has are not scanned again, and the others are entered.
    """
    seen = read_ledger(versions.sparkSession, ledger) if ledger else None
    found, new = find_secrets(versions, seen, text, doc_id)
    if ledger:
        enter(new, ledger)

    def of_kind(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    n = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(F.col("path").alias("doc_id"), *n, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "blob")
