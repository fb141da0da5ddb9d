"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a folder of committed batches: for
each blob, the (rule, rule version) pairs that have been run on it and what they found. A scan runs only the pairs that
the ledger lacks, once for each distinct blob, commits them as one batch, and joins the findings back to all paths.
Matches come from built-in regular expression functions alone.

Defined results: null text is the empty blob; repeated rows each get their findings; a rule keeps leftmost
non-overlapping matches whose kept part is long enough; what two ledger rows both found counts once; a batch that is
sent again changes nothing; an empty table or ledger gives no findings; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BatchStore, regex_spans, shared_table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The match stands if this group has so many characters.
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values. The first three are the base rules, in their order.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is the whole of its run
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE_KINDS = ("assign", "access", "hex")

FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def rule_findings(text: Column, rule: Rule) -> Column:
    spans = regex_spans(text, rule.pattern)
    if rule.least > 1:
        kept = (lambda piece: F.length(F.regexp_extract(piece, rule.pattern, rule.group))) if rule.group else F.length
        spans = F.filter(spans, lambda s: kept(s["piece"]) >= rule.least)
    return F.transform(spans, lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan_blobs(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, pairs, findings): each blob of ``versions`` with the pairs that ``ledger`` lacks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # copies meet within map tasks; what is left moves once, by its address, as the ledger does
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    wanted = F.array(*[F.lit(r.pair) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        known = ledger.select("blob", F.explode(F.array_intersect("pairs", wanted)).alias("pair"))
        seen = known.groupBy("blob").agg(F.collect_set("pair").alias("seen"))  # at most one of each rule asked for
        todo = blobs.join(seen.hint("merge"), "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.expr("cast(array() as array<string>)")))).where(F.size("todo") > 0)
    none = F.expr(f"cast(array() as {FINDINGS})")
    found = F.concat(*[F.when(F.array_contains("todo", r.pair), rule_findings(F.col("body"), r)).otherwise(none) for r in rules])
    return todo.select("blob", F.col("todo").alias("pairs"), found.alias("findings"))


def path_findings(versions: DataFrame, ledger: DataFrame, id_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_cols``, blob and findings (sorted by start, then rule order) of every version, from the ledger alone."""
    version_of = {r.kind: r.pair for r in rules}
    # one ledger row may hold older pairs too: a finding counts if its row ran the rule's present version
    live = ledger.select("blob", F.filter("findings", lambda f: F.array_contains(F.col("pairs"), F.element_at(F.create_map(*[F.lit(x) for kv in version_of.items() for x in kv]), f["kind"]))).alias("findings")).where(F.size("findings") > 0)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    merged = live.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    ranked = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.element_at(order, f["kind"]).alias("rank"), f["end"].alias("end"), f["kind"].alias("kind")))
    tidy = F.transform(F.array_sort(F.array_distinct(ranked)), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    found = shared_table(merged.select("blob", tidy.alias("findings")), "findings")
    paths = versions.select(*id_cols, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return paths.join(found, "blob", "left").select(*id_cols, "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))


LEDGER = f"blob string, pairs array<string>, findings {FINDINGS}"


class Ledger(BatchStore):
    """What has been run on which blob, in committed batches under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, LEDGER)

    def scan(self, batch: str, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> bool:
        """Run on each blob of ``versions`` the rule versions that no batch has run on it; False if the batch was committed before."""
        known = self.rows() if self.batches() else None
        return self.commit(batch, scan_blobs(versions, text_col, known, rules))

    def findings(self, versions: DataFrame, id_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        return path_findings(versions, self.rows(), id_cols, text_col, rules)


def scan_secrets(versions: DataFrame, id_cols: list[str], text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger with what this scan has added): one scan without a folder."""
    added = shared_table(scan_blobs(versions, text_col, ledger, rules), "ledger")
    whole = added if ledger is None else ledger.select("blob", "pairs", "findings").unionByName(added)
    return path_findings(versions, whole, id_cols, text_col, rules), whole


def joined_spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
