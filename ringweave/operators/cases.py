"""Investigation cases: readiness, register, targets and the audit log.

A case: case_id, status, source_community_id, targets array<struct<type, id>>,
decision struct<disposition, rationale, snapshot struct<...>>, sar_exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ENTITIES = ("ACCOUNT", "TRANSACTION", "COMMUNITY")


def checks() -> dict[str, Column]:
    some = lambda c: F.coalesce(c, F.lit(False))
    return {
        "source": F.col("source_community_id").isNotNull(),
        "decision": F.col("decision").isNotNull(),
        "snapshot": F.col("decision.snapshot").isNotNull(),
        "rationale": some(F.trim("decision.rationale") != ""),
        "entities": some(F.size("targets") > 0),
        "export": some(F.col("sar_exported")),
    }


def readiness(cases: DataFrame) -> DataFrame:
    """case_id, dossier_status, outstanding checks by name."""
    c = checks()
    linked = F.coalesce(F.exists("targets", lambda t: t["type"].isin(*ENTITIES)), F.lit(False))
    ready = c["decision"] & c["rationale"] & c["snapshot"] & linked & c["source"]
    outstanding = F.array_compact(F.array(*(F.when(~v, k) for k, v in c.items())))
    return cases.select("case_id", F.when(ready, "READY").otherwise("INCOMPLETE").alias("dossier_status"), F.size(outstanding).alias("open_checks"), F.array_join(outstanding, ",").alias("outstanding"))


def register(cases: DataFrame) -> DataFrame:
    """measure, key, n: cases by status and disposition, exports, ready dossiers."""
    rows = cases.join(readiness(cases), "case_id")
    disposition = F.coalesce("decision.disposition", F.lit("PENDING"))
    mark = lambda measure, key: F.struct(F.lit(measure).alias("measure"), key.alias("key"))
    marks = F.array(
        mark("status", F.col("status")),
        mark("disposition", disposition),
        F.when(F.col("sar_exported"), mark("sar", F.lit("exported"))),
        F.when(F.col("dossier_status") == "READY", mark("dossier", F.lit("READY"))),
    )
    return rows.select(F.explode(F.array_compact(marks)).alias("m")).groupBy("m.measure", "m.key").agg(F.count("*").alias("n"))


def targets(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", "status", F.explode("targets").alias("t")).select("case_id", "status", F.col("t.type").alias("type"), F.col("t.id").alias("id"))


def in_open_case(ids: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows of ids (id) that are a target of a case that isn't closed; upper and lower case are the same."""
    open_ = targets(cases).filter("status <> 'CLOSED'").select(F.lower("id").alias("key")).distinct()
    return ids.join(open_.hint("merge"), F.lower("id") == F.col("key"), "left_semi")


def totals(cases: DataFrame, transactions: DataFrame, features: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per case: targets by type, volume of its transactions and communities, evidence by severity."""
    rows = targets(cases)
    tx = rows.filter("type = 'TRANSACTION'").join(transactions.select(F.col("transaction_id").alias("id"), "amount").hint("merge"), "id")
    com = rows.filter("type = 'COMMUNITY'").join(features.select(F.col("community_id").cast("string").alias("id"), F.col("total_transaction_amount").alias("amount")).hint("merge"), "id")
    volume = tx.select("case_id", "amount").unionByName(com.select("case_id", "amount")).groupBy("case_id").agg(F.sum("amount").alias("volume"))
    kinds = rows.groupBy("case_id").agg(*(F.count_if(F.col("type") == k).alias(k.lower() + "_targets") for k in ENTITIES))
    found = rows.join(evidence.select(F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), "severity").hint("merge"), ["type", "id"]).groupBy("case_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower() + "_evidence") for s in ("HIGH", "MEDIUM", "LOW")))
    return cases.select("case_id").join(kinds.hint("merge"), "case_id", "left").join(volume.hint("merge"), "case_id", "left").join(found.hint("merge"), "case_id", "left").na.fill(0)


def snapshots(cases: DataFrame, scores: DataFrame, features: DataFrame, at: str) -> DataFrame:
    """case_id, snapshot_ts and what was known of its community at decision time; to be appended to a table."""
    known = scores.filter("entity_type = 'COMMUNITY'").join(features.select(F.col("community_id").cast("string").alias("entity_id"), "member_count", "density"), "entity_id")
    return cases.join(known, F.col("source_community_id").cast("string") == F.col("entity_id")).select("case_id", F.lit(at).cast("timestamp").alias("snapshot_ts"), "evidence_score", "item_count", "high_count", "medium_count", "low_count", "member_count", "density")


def current(log: DataFrame) -> DataFrame:
    """The present status of each case in an append-only log (case_id, seq, ts, status)."""
    return log.groupBy("case_id").agg(F.max_by(F.col("status"), F.struct("ts", "seq")).alias("status"), F.count("*").alias("events"))
