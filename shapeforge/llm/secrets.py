"""Incremental secret scans with DataFrame functions only: a ledger of content-addressed blobs.

Every historical version of a file is addressed by the SHA-256 of its whole text. The ledger holds one row per
(blob, rule, rule version) already scanned, with the spans found; only unseen pairs are scanned, and findings are joined
back to all paths and versions that hold the blob.

Defined results: a null text is the empty text; copies share one scan; a blob without findings is in the ledger all
the same, so it isn't scanned again; a changed rule version makes every blob unseen for that rule alone; other columns,
whatever their names, are not read; texts of any length and any number of matches are taken whole, in time that grows in
proportion; spans that begin together stand in the order of the rules; an empty table gives an empty result. Spans are code
points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are taken leftmost and without overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Fixed values. Runs that are maximal by themselves carry their least length in the pattern.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules of this library's own.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"(?:ghp|gho|ghs|glpat)[_-][A-Za-z0-9_]{20,}"),
)
RULES = BASE_RULES + MORE_RULES


#: Matches are placed in blocks of so many, so that the work stays in proportion to them.
_BLOCK = 256
_PLACED = "array<struct<start:int,end:int,n:int>>"
_SPANS = "array<struct<start:int,kind:string,end:int>>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _placed(steps: Column) -> Column:
    """(start, end, n) of matches, from the length of the gap before each and its own: sums within blocks, then over blocks."""
    none = F.array().cast(_PLACED)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["n"].alias("n"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(k):
        return F.aggregate(F.slice(steps, k * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def join(acc, b):
        moved = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["n"].alias("n")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), block)
    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACED}>").alias("out")), join, lambda acc: acc["out"]))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) of one rule's matches.

    The matches come in order, and so do the pieces between them: lengths add up to places.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))

    def found(ms):
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else ms
        sized = F.zip_with(ms, values, lambda m, v: F.struct(F.char_length(m).alias("size"), F.char_length(v).alias("n")))
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(ms))
        steps = F.zip_with(gaps, sized, lambda g, x: F.struct(F.char_length(g).alias("gap"), x["size"].alias("size"), x["n"].alias("n")))
        good = F.filter(_let(steps, _placed), lambda x: x["n"] >= rule.least)
        spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))
        return F.when(F.size(ms) == 0, F.array().cast(_SPANS)).otherwise(spans)

    return _let(whole, found)


def blobs_of(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """``blob_id, text``: one row per content, pre-aggregated before the shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(F.sha2(text, 256).alias("blob_id"), text.alias("text")).dropDuplicates(["blob_id"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows: ``blob_id, rule, rule_version, spans`` for every pair that ``ledger`` doesn't have."""
    blobs = blobs_of(versions, text_col)
    if ledger is None:
        work = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "rule", F.col("rule_version").cast("string"))).alias("seen"))
        work = blobs.join(seen, "blob_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        work = work.where(F.size(F.array_except(F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules]), F.col("seen"))) > 0)
    none = F.lit(None).cast(_SPANS)
    rows = F.array(*[
        F.struct(*[F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(F.array_contains("seen", f"{r.kind}@{r.version}"), none).otherwise(spans_of(F.col("text"), r)).alias("spans")])
        for r in rules
    ])
    return work.select("blob_id", F.explode(rows).alias("r")).select("blob_id", "r.rule", "r.rule_version", "r.spans").where(F.col("spans").isNotNull())


def findings_by_path(versions: DataFrame, ledger: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Every row of ``versions`` (its ``keys`` columns) with ``blob_id`` and ``spans`` of all rules, in order of start, then kind."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    rows = ledger.where(F.array_contains(current, F.concat_ws("@", "rule", F.col("rule_version").cast("string"))) & (F.size("spans") > 0))
    per_blob = rows.groupBy("blob_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    per_blob = per_blob.select("blob_id", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.try_element_at(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("spans"))
    at = versions.select(*[F.col(f"`{k}`") for k in keys], F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob_id"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return at.join(per_blob, "blob_id", "left").withColumn("spans", F.coalesce("spans", none))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every document, the ledger's new rows)."""
    new = cut(scan_unseen(docs, ledger, rules, text_col))
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return findings_by_path(docs, whole, [id_col], rules, text_col), new
