"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every historical version of every path is content-addressed by SHA-256.  The ledger holds one row for
each ``(blob, rule_version)`` pair that has been scanned, findings or none, so a scan reads only the
blobs that no earlier scan with the same rules has read: copies are scanned once, and new rules rescan
old blobs with the new rules alone.  Findings are joined back to all paths that hold the blob.

Texts that occur once are scanned where they are; only texts of digests that occur more than once (a
filter of bounded size finds them) are shuffled, to pick one text for each, with map-side combining.

Spans come from ``split`` and ``regexp_extract_all`` on one pattern: their pieces alternate, so running
lengths give code point offsets without leaving the JVM.

``scan_into`` keeps the ledger at a path, so a later run scans what is new and no more.

Defined results: a null text counts as empty; a text without findings has counts of 0, the digest of the
empty string and an empty ``spans``; very long texts are scanned whole; ties have an order, that of the kinds; rows that repeat an id or a text each get their own result row; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, store, table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` is too short are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    probe: str  #: a cheap pattern that every text with a finding has


#: Rule versions.  A version is never edited; a new rule is a new version.
RULES: dict[int, tuple[Rule, ...]] = {
    1: (
        Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:passw|secret|token|api_?key)"),
        Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16, r"AKIA[A-Z0-9]{12}"),
        Rule("hex", r"([0-9a-f]{32,})", 1, 32, r"[0-9a-f]{32}"),
    ),
    2: (
        Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1, r"PRIVATE KEY-----"),
        Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 24, r"eyJ"),
        Rule("url", r"([a-z][a-z0-9+]{2,15}://[^\s:@/]{1,64}:[^\s:@/]{1,128}@)", 1, 1, r"://"),
    ),
}
BASE = ("assign", "access", "hex")
KINDS = tuple(rule.kind for version in sorted(RULES) for rule in RULES[version])

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(body: Column, rule: Rule) -> Column:
    """Spans of one rule in a text, as ``array<struct<start, rank, kind, end>>``."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(body, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), F.length)
    inner = F.transform(F.regexp_extract_all(body, pattern, F.lit(rule.group)), F.length)
    matches = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), inner.alias("inner"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["0"]
        end = start + F.coalesce(x["1"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(rule.kind)).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        ok = F.coalesce(x["2"], F.lit(-1)) >= rule.least
        return F.struct(end.alias("at"), F.when(ok, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    zipped = F.transform(matches, lambda m: F.struct(m["gap"].alias("0"), m["whole"].alias("1"), m["inner"].alias("2")))
    return F.when(body.rlike(rule.probe), F.aggregate(zipped, state, step, lambda a: a["found"])).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, version: int) -> DataFrame:
    """Ledger rows of ``blobs (digest, body)`` under one rule version."""
    found = F.flatten(F.array(*[spans_of(F.col("body"), rule) for rule in RULES[version]]))
    return blobs.select("digest", F.lit(version).alias("rule_version"), found.alias("found"))


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every version of every path with its content address."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("body"))


def unseen_digests(paths: DataFrame, ledger: DataFrame, version: int) -> DataFrame:
    """Digests that the ledger lacks under this rule version; only digests move."""
    seen = ledger.where(F.col("rule_version") == version).select("digest")
    return store(paths.select("digest").distinct().join(seen, "digest", "left_anti"), "unseen")


def one_of_each_blob(blobs: DataFrame, paths: DataFrame) -> DataFrame:
    """One ``(digest, body)`` for each blob; texts that occur once stay where they are."""
    counts = paths.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = store(counts.where("n > 1").select("digest"), "repeated")
    blobs = blobs.select("digest", "body")
    filter_ = KeyFilter(repeated, "digest")
    again = filter_.keep(blobs, F.col("digest")).groupBy("digest").agg(F.min("body").alias("body"))
    return filter_.drop(blobs, F.col("digest")).unionByName(again)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, versions: tuple[int, ...] = tuple(sorted(RULES)), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(paths, ledger)``: content addresses of ``docs`` and the ledger with all their blobs scanned."""
    texts = addressed(docs, id_col, text_col)
    paths = store(texts.select("doc_id", "digest"), "paths")
    same = ledger is None  # nothing seen yet: one pass serves all versions
    if same:
        blobs = one_of_each_blob(texts, paths)
        found = F.array(*[F.struct(F.lit(v).alias("rule_version"), F.flatten(F.array(*[spans_of(F.col("body"), r) for r in RULES[v]])).alias("found")) for v in versions])
        new = blobs.select("digest", F.inline(found))
        return paths, store(new, "ledger")
    parts = []
    for v in versions:
        unseen = unseen_digests(paths, ledger, v)
        # a filter of bounded size says which texts to scan; what it lets through besides is left out of the findings
        some = one_of_each_blob(KeyFilter(unseen, "digest").keep(texts, F.col("digest")), paths)
        parts.append(scan(some, v).join(unseen, "digest", "left_semi"))
    return paths, ledger.unionByName(store(reduce(DataFrame.unionByName, parts), "ledger"))


def scan_into(docs: DataFrame, ledger_path: str, versions: tuple[int, ...] = tuple(sorted(RULES)), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report on ``docs`` with the ledger that is kept at a path, for any number of runs; new findings are added to it.

    A run that ends before its findings are committed leaves the ledger as it was.
    """
    spark = docs.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger_path}/_SUCCESS")
    known = None
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.parquet(ledger_path)
    paths, grown = update_ledger(docs, known, versions, id_col, text_col)
    old = None if known is None else known.select("digest", "rule_version")
    new = grown if old is None else grown.join(old, ["digest", "rule_version"], "left_anti")
    store(new, "added").write.mode("append").parquet(ledger_path)
    return report(paths, spark.read.parquet(ledger_path).where(F.col("rule_version").isin(*versions)))


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings joined back to all paths."""
    hits = ledger.where(F.size("found") > 0).groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    hits = store(hits, "hits")
    rows = paths.join(hits.hint("merge"), "digest", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("found", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return report(*update_ledger(docs, ledger, id_col=id_col, text_col=text_col))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _oracle_spans(rank: int, rule: Rule) -> str:
    """Spans of one rule in SQL: gaps between matches and matches alternate."""
    pattern = _either_case(rule.pattern).replace("'", "''")
    gaps, found = f"string_split_regex(body, '{pattern}')", f"regexp_extract_all(body, '{pattern}')"
    return f"""list_filter(list_transform(range(1, len({found}) + 1), lambda i: {{
        s: cast(list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda m: length(m))), 0) as bigint),
        k: {rank}, m: {found}[i], g: regexp_extract_all(body, '{pattern}', {rule.group})[i], kind: '{rule.kind}'}}), lambda x: length(x.g) >= {rule.least})"""


def _either_case(pattern: str) -> str:
    """``(?i)`` folds beyond ASCII in the other engine, so letters outside classes and escapes are spelled out."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, in_class, k = "", False, 4
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            size = 4 if pattern[k + 1] == "x" else 2
            out, k = out + pattern[k : k + size], k + size
            continue
        in_class = (in_class or c == "[") and c != "]"
        out += f"[{c}{c.upper()}]" if c.isalpha() and not in_class else c
        k += 1
    return out


_NUMBERED = [(KINDS.index(rule.kind), rule) for version in sorted(RULES) for rule in RULES[version]]
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as body from documents),
f as (select doc_id, list_sort(list_concat({", ".join(_oracle_spans(rank, rule) for rank, rule in _NUMBERED)})) as found from d)
select doc_id, {", ".join(f"len(list_filter(found, lambda x: x.kind = '{kind}')) as n_{kind}" for kind in BASE)},
    sha256(coalesce(array_to_string(list_transform(list_filter(found, lambda x: x.k < {len(BASE)}), lambda x: x.kind || ':' || x.s || ':' || (x.s + length(x.m))), ','), '')) as base_sha256,
    coalesce(array_to_string(list_transform(found, lambda x: x.kind || ':' || x.s || ':' || (x.s + length(x.m))), ','), '') as spans
from f
"""
