"""Secret scans through an incremental blob ledger; DataFrame functions only.

Every version of every text is addressed by its SHA-256 (blob). The ledger
holds one row for each scanned (blob, rule version) with its findings. A call
scans only pairs that the ledger lacks, appends them, and joins findings back
to all rows, so copies and later runs cost a lookup. The rule version is the
digest of the rules, so a changed rule rescans.

A finding is (kind, start, end) in code points, end exclusive. Matches are
leftmost and non-overlapping per kind; positions are running sums of the
lengths of matches and of the pieces between them, summed by blocks of BLOCK
matches, so that the work grows with the number of matches, however many.

Nulls and odd cases: null text is the empty text, without findings; repeated
rows each get their row; other columns pass through, but for own ones named
blob and findings, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fresh_path, materialise, require, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has `least` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. Runs shorter than asked for never match, so the last two demand the length in the pattern: a maximal run matches whole or not at all.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What this operator adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
FINDINGS = "array<struct<start:long,kind:int,end:long>>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


#: Findings whose positions are summed up in one go; more of them make more blocks, so the work grows with their number only.
BLOCK = 256


def find_spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """texts with `findings`, sorted by start, then by the rules' order."""
    out = texts
    for k, r in enumerate(rules):
        out = out.withColumn(f"_hits{k}", F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
    for k, r in enumerate(rules):
        hits = F.col(f"_hits{k}")
        gaps = F.split("text", r.pattern, -1)
        value = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else hits
        # of each hit: all it and what lies before it take, its own length, that of its group; the last gap has no hit
        parts = F.zip_with(F.zip_with(hits, gaps, lambda h, g: F.struct((F.length(g) + F.length(h)).cast("long").alias("step"), F.length(h).alias("n"))), value, lambda p, v: F.struct(p["step"].alias("step"), p["n"].alias("n"), F.length(v).alias("own")))
        out = out.withColumn(f"_parts{k}", F.when(F.size(hits) > 0, F.slice(parts, 1, F.size(hits))))
    for k in range(len(rules)):
        parts = F.col(f"_parts{k}")
        out = out.withColumn(f"_blocks{k}", F.when(parts.isNotNull(), _blocks(parts)))
    for k in range(len(rules)):
        sums = F.transform(f"_blocks{k}", lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, p: a + p["step"]))
        begins = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        out = out.withColumn(f"_begins{k}", begins)
    out = out.withColumn("findings", F.array_sort(F.concat(*[_spans(k, r) for k, r in enumerate(rules)])))
    return out.drop(*[c for c in out.columns if c.startswith(("_hits", "_parts", "_blocks", "_begins"))])


def _blocks(parts: Column) -> Column:
    last = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))


def _spans(k: int, rule: Rule) -> Column:
    def block(parts: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.lit([]).cast(FINDINGS).alias("found"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + x["step"]
            span = F.struct((end - x["n"]).alias("start"), F.lit(k).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

        return F.aggregate(parts, start, step, lambda acc: acc["found"])

    # one more begin than blocks: the end of the last
    found = F.zip_with(f"_blocks{k}", F.slice(f"_begins{k}", 1, F.size(f"_blocks{k}")), block)
    return F.when(F.col(f"_blocks{k}").isNull(), F.lit([]).cast(FINDINGS)).otherwise(F.flatten(found))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """docs' columns other than text_col, with blob and findings; new findings go to the Parquet folder `ledger` (one writer at a time)."""
    require(docs, text_col)
    spark = docs.sparkSession
    version = rule_version(rules)
    text = text_or_empty(F.col(text_col))
    blob = F.unhex(F.sha2(text, 256))

    def stored() -> DataFrame | None:
        try:
            found = spark.read.schema(f"blob binary, findings {FINDINGS}, rules string").parquet(ledger)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found.where(F.col("rules") == version).select("blob", "findings")

    texts = docs.select(blob.alias("blob"), text.alias("text"))
    if (seen := stored()) is not None:
        unseen = materialise(texts.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
        texts = texts.join(unseen, "blob", "left_semi")
    distinct = texts.groupBy("blob").agg(F.first("text").alias("text"))
    found = find_spans(distinct, rules).select("blob", "findings")
    found.withColumn("rules", F.lit(version)).write.mode("append").partitionBy("rules").parquet(ledger)

    keep = [F.col(c) for c in docs.columns if c != text_col and c.lower() not in ("blob", "findings")]
    rows = docs.select(F.struct(*keep).alias("row") if keep else F.lit(1).alias("row"), blob.alias("key"))
    known = stored()
    return rows.join(known, rows.key == known.blob).select(*(["row.*"] if keep else []), "blob", "findings")


def op5(docs: DataFrame) -> DataFrame:
    """A ledger of its own for each call, so that the figures are those of a first run."""
    rules = BASE + MORE
    found = scan(docs.select("doc_id", "text"), fresh_path(docs.sparkSession, "ledger"), rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")

    base = F.filter("findings", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("findings")).alias("spans"),
    )


def _sql() -> str:
    """The same by DuckDB: every text scanned, positions from lengths of matches and of what lies between."""
    parts = []
    for k, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT n, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM d")
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT n, k, kind, least, h, v, g, unnest(range(1, len(h) + 1)) AS i FROM ({' UNION ALL '.join(parts)}) x WHERE len(h) > 0),
s AS (SELECT n, k, kind, length(h[i]) AS size, length(v[i]) >= least AS ok, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS a FROM m),
f AS (SELECT n, k, a, kind || ':' || CAST(a AS bigint) || ':' || CAST(a + size AS bigint) AS span FROM s WHERE ok),
e AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM f GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN e USING (n)"""


SQL = _sql()
