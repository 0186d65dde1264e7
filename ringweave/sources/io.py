"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.contracts import EVALUATION, LABEL_COLUMNS, OBSERVABLE, ordered, require
from ..operators.features import FEATURES
from ..operators.graph import mirrored

ACCOUNTS = "account_id string, customer_name string, balance double, risk_score double, creation_date string"
TRANSACTIONS = "tx_id string, src_id string, dst_id string, amount double, timestamp string, description string, embedding string"
CASES = "pattern_id string, start_acc_id string, pattern_type string, depth int, involved_accounts string"
EDGE = "struct<source:string,target:string,weight:double,temporal_overlap:int,shared_devices:array<string>,shared_payment_instruments:array<string>,shared_ips:array<string>,shared_merchants:array<string>>"


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCOUNTS).csv(path, header=True).withColumn("creation_date", F.to_date("creation_date"))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of what a reader gave, in file order: by path, then by place in the file.

    Splits are counted first, in the order of their blocks; a row's place is that of
    its split's first row and its own within the split, which the order of row
    numbers in a partition tells. Nothing is sorted, and no task sees all rows."""
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    placed = rows.withColumns({"__split": split, "__row": F.monotonically_increasing_id()})
    sizes = placed.groupBy("__split").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    # a row for each split; only those before the n-th row are joined
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__split")) - F.col("__n")).filter(F.col("__before") < n)
    kept = placed.join(before.hint("merge"), "__split").filter(F.col("__before") + F.col("__row") - F.col("__first") < n)
    return kept.select(*rows.columns)


def read_transactions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The columns that analysis needs; the wide embedding is never parsed. A limit takes the first rows of the file."""
    rows = spark.read.schema(TRANSACTIONS).csv(path, header=True).select("tx_id", "src_id", "dst_id", "amount", F.to_timestamp("timestamp").alias("timestamp"))
    return rows if limit is None else first_rows(rows, limit)


def read_ledger(spark: SparkSession, main: str, fraud: str | None = None, decoy: str | None = None, limit: int | None = None) -> DataFrame:
    """Main, fraud and decoy transactions in one table; a limit holds for the main file only, and takes its first rows."""
    rows = read_transactions(spark, main, limit)
    for path in (fraud, decoy):
        if path is not None:
            rows = rows.unionByName(read_transactions(spark, path))
    return rows


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).csv(path, header=True)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, number, text: a file's JSON in pieces that each end with an object's closing brace, numbered from 0.

    A file is read at braces, in as many tasks as it has splits. A brace inside a
    string is told by the quotes before it: their parity by split comes first, then
    each record's own, and records that end inside a string are put together again."""
    quotes = F.length(F.regexp_replace("value", r'\\.|[^"\\]', ""))
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path, lineSep="}").select(*split, F.monotonically_increasing_id().alias("row"), "value", (quotes % 2).alias("odd"))
    own = W.partitionBy("path", "start").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn("inside", F.sum("odd").over(own) % 2)  # whether a record ends in a string, were its split to begin outside of one
    sums = inside.groupBy("path", "start").agg(F.sum("odd").alias("odd"), F.sum("inside").alias("within"), F.count("*").alias("n"))
    # a row for each split
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("flip", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    sums = sums.withColumn("ends", F.when(F.col("flip") == 0, F.col("n") - F.col("within")).otherwise(F.col("within")))
    sums = sums.withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0))).select("path", "start", "flip", "before")
    ended = (F.col("inside") == F.col("flip")).cast("long")
    placed = inside.join(sums.hint("merge"), ["path", "start"]).withColumn("ended", ended)
    placed = placed.withColumn("number", F.col("before") + F.sum("ended").over(own) - F.col("ended"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "row", "value"))), lambda x: x["value"])
    return placed.groupBy("path", "number").agg(F.concat(F.array_join(parts, "}"), F.lit("}")).alias("text"))


STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
RUN = 1 << 16


def read_community_edges(spark: SparkSession, path: str) -> DataFrame:
    """community_id and edges from JSON of edge lists by community, seen from either end. Edges hold no objects.

    One large file is read by many tasks. An edge's community is the last key before
    it: keys are carried on within runs of objects, and from run to run by each run's
    last one. Lists that are empty or null give no rows."""
    pieces = json_objects(spark, path)
    text = F.when(F.col("number") == 0, F.regexp_replace("text", r"^[\s\uFEFF]*\{", "")).otherwise(F.col("text"))
    head = F.regexp_extract("text", rf"^(?:[\s,\]]++|{STRING}\s*:\s*(?:\[|null))*+", 0)
    pieces = pieces.withColumn("text", text).withColumn("head", head)
    key = F.regexp_extract("head", rf"({STRING})\s*:\s*\[\s*$", 1)
    edges = pieces.select("path", "number", F.floor(F.col("number") / RUN).alias("run"), F.when(key != "", key).alias("key"), F.expr("substring(text, length(head) + 1)").alias("edge")).filter(F.col("edge").startswith("{"))
    own = W.partitionBy("path", "run").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    edges = edges.withColumn("key", F.last("key", ignorenulls=True).over(own))
    lasts = edges.groupBy("path", "run").agg(F.max_by("key", "number").alias("last"))
    lasts = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(W.partitionBy("path").orderBy("run").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    named = edges.join(lasts.hint("merge"), ["path", "run"]).withColumn("key", F.coalesce("key", "carried"))
    rows = named.select(F.trim("key", F.lit('"')).cast("long").alias("community_id"), F.from_json("edge", EDGE).alias("e")).select("community_id", "e.*")
    return mirrored(rows.withColumnsRenamed({"source": "src", "target": "dst"}))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), ["community_id", *FEATURES], (*EVALUATION, *LABEL_COLUMNS)).select("community_id", *FEATURES)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), ["community_id", "is_positive"], ()).select("community_id", F.col("is_positive").cast("int").alias("is_positive"))


def read_observable(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = require(rows.drop(*EVALUATION), ["transaction_id"]).select(*(c for c in OBSERVABLE if c in rows.columns))
    return rows if limit is None else first_rows(rows, limit)


def write_ledger(ledger: DataFrame, path: str, kind: str = "parquet") -> None:
    out = ordered(ledger).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def write_tables(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
