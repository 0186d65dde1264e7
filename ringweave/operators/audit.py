"""The audit log of cases: events made from successive states, appended once, and played back to the present state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Names of the events by changed field.
EVENTS = {"status": "STATUS_CHANGED", "notes": "NOTES_UPDATED", "decision": "DECISION_RECORDED", "sar_exported": "SAR_EXPORTED"}
CREATED, ADDED, REMOVED = "CASE_CREATED", "TARGET_ADDED", "TARGET_REMOVED"
LOG = "event_id string, case_id string, ts timestamp, seq long, event_type string, field string, before string, after string"


def _event(kind: Column, field: Column, before: Column, after: Column) -> Column:
    return F.struct(kind.alias("event_type"), field.alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"))


def changes(states: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One event for each field that differs from the state before (case_id, ts, seq, fields, and targets array<struct<type, id>> if there is that column), in LOG's columns.

    A case's first state also gives CASE_CREATED, and an event for each field that
    isn't null. States of a case are put in order by (ts, seq); rows that repeat
    both are one state. Targets are the same whatever their letters' case.
    event_id is a hash of case, ts, seq, field and target: the same states give the
    same events."""
    fields = [f for f in fields or EVENTS if f in states.columns]
    own, text = W.partitionBy("case_id").orderBy("ts", "seq"), F.lit(None).cast("string")
    rows = states.dropDuplicates(["case_id", "ts", "seq"])
    before = F.lag(F.struct(*(c for c in (*fields, "targets") if c in rows.columns), F.lit(True).alias("there"))).over(own)
    rows = rows.withColumn("last", before)
    found = [F.when(F.col("last.there").isNull(), _event(F.lit(CREATED), text, text, text))]
    for f in fields:
        found.append(F.when(~F.col(f).eqNullSafe(F.col(f"last.{f}")), _event(F.lit(EVENTS.get(f, f"{f.upper()}_CHANGED")), F.lit(f), F.col(f"last.{f}"), F.col(f))))
    events = F.array_compact(F.array(*found))
    if "targets" in rows.columns:
        name = lambda t: F.concat(t["type"], F.lit(":"), F.lower(t["id"]))
        empty = F.array().cast("array<string>")
        now, then = (F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast(states.schema["targets"].dataType)), name)) for c in ("targets", "last.targets"))
        now, then = F.coalesce(now, empty), F.coalesce(then, empty)
        added = F.transform(F.array_except(now, then), lambda t: _event(F.lit(ADDED), F.lit("targets"), text, t))
        gone = F.transform(F.array_except(then, now), lambda t: _event(F.lit(REMOVED), F.lit("targets"), t, text))
        events = F.concat(events, added, gone)
    out = rows.select("case_id", "ts", F.col("seq").cast("long").alias("seq"), F.explode(events).alias("e")).select("case_id", "ts", "seq", "e.*")
    target = F.when(F.col("field") == "targets", F.coalesce("after", "before")).otherwise(F.lit(""))
    name = F.concat_ws("\n", "case_id", F.unix_micros("ts").cast("string"), F.col("seq").cast("string"), "event_type", F.coalesce("field", F.lit("")), target)
    return out.select(F.concat(F.lit("evt_"), F.substring(F.sha2(name, 256), 1, 24)).alias("event_id"), "case_id", "ts", "seq", "event_type", "field", "before", "after")


def append(log: str, events: DataFrame) -> DataFrame:
    """The log at a path after those events that it lacks were added; a run that is repeated, or events that come twice, add nothing."""
    spark = events.sparkSession
    new = events.dropDuplicates(["event_id"])
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(read(spark, log).select("event_id").hint("merge"), "event_id", "left_anti")
    new.select([c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(log)
    return read(spark, log)


def read(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)


def present(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """case_id, the fields as they are now, targets (sorted, type:id) and the number of events, from the log alone."""
    fields = list(fields or EVENTS)
    order = F.struct("ts", "seq")
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.struct("after")), F.when(F.col("field") == f, order))["after"].alias(f)
    plain = events.groupBy("case_id").agg(*map(last, fields), F.count("*").alias("events"))
    each = events.filter("field = 'targets'").withColumn("target", F.coalesce("after", "before")).groupBy("case_id", "target").agg(F.max_by("event_type", order).alias("kind"))
    kept = each.filter(F.col("kind") == ADDED).groupBy("case_id").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    return plain.join(kept.hint("merge"), "case_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
