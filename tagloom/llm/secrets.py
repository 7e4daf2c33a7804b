"""Secret scans over versions of blobs, kept in an incremental ledger.

Every version of a text is addressed by the SHA-256 of its content.  The ledger
holds one row per scanned (blob, rules version) with its findings.  Only blobs
without a row for the current rules are scanned, each once however many paths
and versions carry it; the findings are then joined back to all paths.  All
steps are column expressions.

Defined results: a null text is the empty blob; repeated rows each get the
findings of their blob; a null path stays null.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import spans
from tagloom.llm.common import narrow, written

# Fixed patterns of the rules; a hex or access match of too few characters has no longer one inside it.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")
RULES_VERSION = "1"
LEDGER = f"blob string, rules string, spans {spans.SPAN}"


def find(text: Column) -> Column:
    """Ordered secret spans of a text: one cheap test per rule, positions only where it holds."""
    assign = F.filter(spans.matches(text, "assign", 0, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6)
    access = F.when(F.contains(text, F.lit("AKIA")), spans.matches(text, "access", 1, ACCESS)).otherwise(spans.nothing())
    found = F.concat(assign, access, spans.matches(text, "hex", 2, HEX))
    # The ledger is a table that many may read: it keeps places, never the secrets themselves.
    hidden = F.transform(found, lambda x: x.withField("value", F.lit(None).cast("string")))
    return spans.ordered(hidden)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION) -> DataFrame:
    """New ledger rows for ``versions(blob, text)``: its distinct blobs that the ledger lacks.

    Copies of a blob meet before any exchange.
    """
    # Equal blobs are equal texts: any one stands for all, chosen by its address alone.
    distinct = versions.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is not None:
        # Distinct blobs lie by address already: only the ledger's addresses move.
        known = ledger.filter(F.col("rules") == rules).select("blob")
        distinct = distinct.join(known, "blob", "left_anti")
    return distinct.select("blob", F.lit(rules).alias("rules"), find(F.col("text")).alias("spans"))


def scan_commits(
    commits: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", rules: str = RULES_VERSION
) -> tuple[DataFrame, DataFrame]:
    """Scan versions of a table one after the other with one ledger: the last one's findings and the ledger.

    Every commit scans only blobs that no earlier one held.
    """
    ledger, found = None, None
    for commit in commits:
        found, fresh = secret_scan(commit, ledger, id_col, text_col, rules)
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
    return found, ledger


def secret_scan(
    versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    rules: str = RULES_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """(findings per row: id, blob, spans; new ledger rows).

    Append the second to the ledger for the next run.  Blobs that repeat are
    joined through their address with a tag, so a hot blob can be split.
    """
    rows = narrow(versions, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    fresh = written(scan_blobs(rows.select("blob", "text"), ledger, rules), "ledger")
    known = fresh.select("blob", "spans")
    if ledger is not None:
        known = known.unionByName(ledger.filter(F.col("rules") == rules).select("blob", "spans"))
    hits = known.filter(F.size("spans") > 0).select("blob", "spans", F.xxhash64("blob").alias("tag"))
    hits = hits.dropDuplicates(["blob"])
    found = (
        rows.select("id", "blob", F.xxhash64("blob").alias("tag")).join(hits, ["blob", "tag"], "left")
        .select("id", "blob", F.coalesce("spans", spans.nothing()).alias("spans"))
    )
    return found, fresh
