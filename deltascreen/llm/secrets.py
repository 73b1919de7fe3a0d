"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text. The ledger has a row for each
blob and the rule versions it was scanned with, findings or none. A scan takes only the blobs that
lack a rule version, once for all paths that share the text, and findings are joined back to all
paths. Rules are regular expressions; a changed rule has another version and is scanned anew.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.llm.common import stage, unused, whole_text

MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: In the order in which kinds are listed. Runs of one class are matched whole, so a least length in
#: the pattern finds what a longer match with a later test would.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE = ("assign", "access", "hex")


def blob_of(column: str | Column) -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.col(column) if isinstance(column, str) else column, 256))


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob)`` for every row: a path with several texts has several versions."""
    return docs.select(F.col(path_col).alias("path"), blob_of(whole_text(text_col)).alias("blob"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "blob binary, versions array<string>, findings array<struct<start:int,rank:int,kind:string,end:int,version:string>>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, missing)``: the rule versions that each distinct blob was not scanned with."""
    wanted = F.array(*[F.lit(r.version) for r in rules])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
    missing = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", missing.alias("missing")).where(F.size("missing") > 0)


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    """Lengths of the text before each match, of the match and of its tested group; null without a match."""
    pattern = F.lit(rule.pattern)
    there = text.rlike(rule.pattern)
    if rule.hint:
        there = text.contains(rule.hint) & there
    size = lambda a: F.transform(a, F.length)
    parts = F.arrays_zip(
        size(F.split(text, rule.pattern, -1)).alias("before"),
        size(F.regexp_extract_all(text, pattern, F.lit(0))).alias("found"),
        size(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("tested"),
    )
    return F.when(wanted & there, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), parts.alias("parts")))


def scan(docs: DataFrame, todo: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the blobs in ``todo``: ``(blob, findings)``, blobs without any left out.

    Places are code points from 0, the end exclusive. Each blob is scanned once, whatever the number
    of rows with its text.
    """
    texts = docs.select(blob_of(whole_text(text_col)).alias("blob"), whole_text(text_col).alias("text"))
    texts = texts.dropDuplicates(["blob"]).join(todo, "blob")
    each = F.array_compact(F.array(*[_matches(r, F.col("text"), F.array_contains("missing", r.version)) for r in rules]))
    hits = texts.select("blob", F.explode(each).alias("hit")).select("blob", "hit.kind", "hit.version", F.posexplode("hit.parts").alias("at", "part"))
    hits = hits.select("blob", "kind", "version", "at", "part.*").where("found is not null")
    upto = W.partitionBy("blob", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("found")).over(upto)
    placed = hits.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("found"))
    rank = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    long_enough = F.coalesce(*[F.when(F.col("kind") == r.kind, F.col("tested") >= r.least) for r in rules])
    finding = F.struct("start", rank.alias("rank"), "kind", "end", "version")
    return placed.where(long_enough).groupBy("blob").agg(F.sort_array(F.collect_list(finding)).alias("findings"))


def update_ledger(docs: DataFrame, ledger_path: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``docs`` has that the ledger lacks, append it, and return the table of versions."""
    spark = docs.sparkSession
    paths = stage(versions(docs, path_col, text_col), "versions")
    todo = stage(unseen(paths, read_ledger(spark, ledger_path), rules), "unseen")
    found = scan(docs, todo, text_col, rules)
    none = F.array().cast(found.schema["findings"].dataType)
    rows = todo.join(found, "blob", "left").select("blob", F.col("missing").alias("versions"), F.coalesce("findings", none).alias("findings"))
    rows.write.mode("append").parquet(ledger_path)
    return paths


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, findings)`` by the current rule versions, sorted, for blobs that have any."""
    current = [r.version for r in rules]
    each = ledger.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.version").isin(current))
    return each.groupBy("blob").agg(F.sort_array(F.collect_set("f")).alias("findings"))


def find_secrets(docs: DataFrame, ledger_path: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(path, blob, findings)`` for every row of ``docs``, after bringing the ledger up to date.

    ``findings`` holds ``(start, rank, kind, end, version)`` by start, then by the order of the rules;
    it is empty where there is none. A null text counts as empty. Repeated rows come back as often as
    they are given, paths may be null. Other columns are ignored; an empty table gives an empty result.
    """
    paths = update_ledger(docs, ledger_path, path_col, text_col, rules)
    found = blob_findings(read_ledger(docs.sparkSession, ledger_path), rules)
    none = F.array().cast(found.schema["findings"].dataType)
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", none).alias("findings"))


def redact(docs: DataFrame, ledger_path: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span, or run of overlapping spans, replaced by ``MARK``.

    All columns stay; a text without findings (a null one, too) stays as it is.
    """
    update_ledger(docs, ledger_path, path_col, text_col, rules)
    spans, rest, blob, of = (unused(n, docs) for n in ("_cuts", "_rest", "_blob", "_of"))
    each = blob_findings(read_ledger(docs.sparkSession, ledger_path), rules).select("blob", F.explode("findings").alias("f")).select("blob", "f.start", "f.end")
    before = W.partitionBy("blob").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    cuts = each.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0))).where(F.col("end") > F.col("from"))
    # a cut keeps the text from the end of the cuts before it to its own start
    cut = F.struct("from", F.greatest(F.col("start") - F.col("from"), F.lit(0)).alias("n"), (F.col("start") >= F.col("from")).alias("mark"))
    cuts = cuts.groupBy("blob").agg(F.sort_array(F.collect_list(cut)).alias(spans), F.max("end").alias(rest))
    text = F.col(text_col)
    kept = F.transform(spans, lambda c: F.concat(text.substr(c["from"] + 1, c["n"]), F.when(c["mark"], F.lit(MARK)).otherwise(F.lit(""))))
    whole = F.concat(F.array_join(kept, ""), text.substr(F.col(rest) + 1, F.lit(2147483647)))
    joined = docs.withColumn(blob, blob_of(whole_text(text_col))).join(cuts.withColumnRenamed("blob", of), F.col(blob) == F.col(of), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(whole)).select(*docs.columns)


def of_kinds(*kinds: str) -> Column:
    """The findings of some kinds."""
    return F.filter("findings", lambda f: f["kind"].isin(*kinds))


def joined_spans(findings: Column) -> Column:
    """``kind:start:end`` of each finding, comma-joined."""
    say = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.array_join(F.transform(findings, say), ",")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB statement for the digest of all documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = "\nUNION ALL ".join(
        f"SELECT n, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, {quoted(r.pattern)}) AS before, "
        f"regexp_extract_all(text, {quoted(r.pattern)}) AS found, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS tested FROM t"
        for i, r in enumerate(rules)
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT * FROM ({kinds}) WHERE len(found) > 0),
rows_ AS (SELECT n, rank, kind, least, before, found, tested, unnest(range(1, len(found) + 1)) AS i FROM parts),
spans AS (
  SELECT n, rank, kind, i, length(found[i]) AS size, least, length(tested[i]) AS tested,
    sum(length(before[i]) + length(found[i])) OVER (PARTITION BY n, rank ORDER BY i) AS stop FROM rows_),
kept AS (SELECT n, rank, kind, (stop - size)::BIGINT AS start, concat(kind, ':', stop - size, ':', stop) AS said FROM spans WHERE tested >= least),
digest AS (
  SELECT n, {counts}, coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '') AS base,
    string_agg(said, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN digest USING (n)
"""
