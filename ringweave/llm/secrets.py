"""Secret scans with a random forest, in DataFrame and SQL functions and Spark's own forest.

Candidates are the values in words, apart from quotes, brackets and separators, that
a digit or many capitals set apart from prose: of LONG characters, or of SHORT if
they are assigned to a telling name. A word may hold several. Each is described by its length, its characters and their
transitions, the share of its letters that corpus words cover, path-like marks,
and the words before it. The forest learns from labelled findings and removes
false positives from the rest. Findings are labelled by the caller or, failing
that, by `label_findings`: known formats and values assigned to a telling name
are secrets; addresses, plain numbers and values without both letters and digits
are not; all others stay open and are left to the forest.

The dictionary is counted over the whole corpus. The forest learns from SAMPLE
labelled findings at most, those with the smallest hashes.

Defined results: null and empty texts have no candidates; without labelled
findings of both classes a candidate's score is its label (open: 0); rows with
the same id are told apart by their text; each occurrence is a finding; an empty
table has none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

SAMPLE, TREES, DEPTH, SEED, COMMON = 20_000, 40, 6, 5, 3
LONG, SHORT = 16, 8
NAMES = r"(?i)(token|secret|passw(or)?d|pwd|api_?key|access_?key|private_?key|auth|credential|bearer)"
KNOWN = r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{30,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_.-]{10,})$"
VALUE = r"(?:([0-9A-Za-z_.-]{2,40})[\"'`]?[=:][\"'`]*)?([0-9A-Za-z_+/.@~=!$%^*#-]{8,})"
FEATURES = ["chars", "distinct", "digits", "uppers", "vowels", "hexes", "turns", "run", "covered", "dots", "slashes", "at_sign", "named", "assigned", "quoted", "spaced"]


def share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def candidates(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, key (xxhash64 of the text), at (word number from 0), value, name (what it is assigned to, or the words before), quoted, assigned."""
    words = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.split(F.col(text_col), r"[\x20\x09-\x0D]+").alias("words"))
    may = lambda w: (F.length(w) >= SHORT) & (w.rlike("[0-9]") | w.rlike("[A-Z]{20}"))
    near = lambda i: F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1))
    told = F.filter(F.transform("words", lambda w, i: F.when(may(w), F.struct(i.alias("at"), w.alias("word"), near(i).alias("before")))), lambda x: x.isNotNull())
    rows = words.select("id", "key", F.explode(told).alias("c")).select("id", "key", "c.*")
    part = lambda group: F.regexp_extract_all("word", F.lit(VALUE), F.lit(group))
    rows = rows.withColumn("x", F.explode(F.zip_with(part(1), part(2), lambda inner, value: F.struct(inner.alias("inner"), value.alias("value")))))
    # what is assigned ends where a host begins; closing marks belong to the sentence
    value = F.regexp_replace(F.when(F.col("x.inner") != "", F.regexp_replace("x.value", "@.*", "")).otherwise(F.col("x.value")), "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    rows = rows.select("id", "key", "at", "word", "before", F.col("x.inner").alias("inner"), value.alias("value"))
    assigned = (F.col("inner") != "") | F.col("before").rlike("[=:][\"'`]*$")
    named = F.concat_ws(" ", "before", "inner").rlike(NAMES)
    odd = F.col("value").rlike("[0-9]") | F.col("value").rlike("[A-Z]{20}")
    return rows.filter(odd & ((F.length("value") >= LONG) | (assigned & named & (F.length("value") >= SHORT)))).select(
        "id", "key", "at", "value",
        F.concat_ws(" ", "before", "inner").alias("name"),
        F.col("word").rlike("[\"'`]").alias("quoted"),
        assigned.alias("assigned"),
    )


def dictionary(docs: DataFrame, *, text_col="text") -> DataFrame:
    """word: the corpus's words of 3 to 12 lower-case letters that occur COMMON times or more."""
    words = docs.select(F.explode(F.split(F.col(text_col), r"[\x20\x09-\x0D]+")).alias("word")).filter((F.length("word").between(3, 12)) & F.col("word").rlike(r"^\p{Ll}+$"))
    return words.groupBy("word").count().filter(F.col("count") >= COMMON).select("word")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with FEATURES."""
    v = F.col("value")
    runs = F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}"), F.lit(0))
    values = found.select("value").distinct()
    parts = values.select("value", F.explode(runs).alias("word"))
    covered = parts.join(words.hint("shuffle_hash"), "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    turns = F.regexp_count(v, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    run = F.array_max(F.transform(F.regexp_extract_all(v, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)), lambda x: F.length(x)))
    return (
        found.join(covered.hint("merge"), "value", "left")
        .withColumn("chars", F.length(v).cast("double"))
        .withColumn("distinct", F.size(F.array_distinct(F.split(v, ""))) / F.length(v))
        .withColumn("digits", share(v, "[0-9]"))
        .withColumn("uppers", share(v, "[A-Z]"))
        .withColumn("vowels", share(v, "[aeiouAEIOU]"))
        .withColumn("hexes", share(v, "[0-9a-f]"))
        .withColumn("turns", turns / F.length(v))
        .withColumn("run", run / F.length(v))
        .withColumn("covered", F.coalesce("letters", F.lit(0)) / F.length(v))
        .withColumn("dots", share(v, r"\."))
        .withColumn("slashes", share(v, "[/\\\\]"))
        .withColumn("at_sign", v.contains("@").cast("double"))
        .withColumn("named", F.col("name").rlike(NAMES).cast("double"))
        .withColumn("assigned", F.col("assigned").cast("double"))
        .withColumn("quoted", F.col("quoted").cast("double"))
        .withColumn("spaced", F.size(F.split("name", " ")).cast("double"))
        .drop("letters")
    )


def label_findings(rows: DataFrame) -> DataFrame:
    """label: 1 for known formats and mixed values assigned to a telling name, 0 for what can't be a secret, null for all others."""
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("distinct") > 0.2)
    secret = F.col("value").rlike(KNOWN) | ((F.col("named") == 1) & (F.col("assigned") == 1) & mixed & (F.col("at_sign") == 0))
    harmless = (F.col("at_sign") == 1) | ~mixed | (F.col("dots") > 0.1) | (F.col("covered") > 0.6)
    return rows.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", labelled: DataFrame | None = None, sample=SAMPLE, accept=0.5) -> DataFrame:
    """id, key, at, value, name, score of the findings that the forest accepts. labelled: value and label (0, 1) of known findings."""
    found = stored(candidates(docs, id_col=id_col, text_col=text_col), "secrets-candidates")
    rows = described(found, dictionary(docs, text_col=text_col))
    if labelled is None:
        rows = label_findings(rows)
    else:
        known = labelled.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("label"))
        rows = rows.join(known.hint("merge"), "value", "left")
    rows = stored(rows, "secrets-described")
    place = F.xxhash64("value", "at", "id")
    chosen = rows.filter("label IS NOT NULL").withColumn("place", place)
    # as many of either class as half the sample, at most
    parts = [chosen.filter(F.col("label") == c).orderBy("place", "key").limit(sample // 2) for c in (0.0, 1.0)]
    train = stored(parts[0].unionByName(parts[1]).repartition(1).sortWithinPartitions("place", "key"), "secrets-labelled")
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    if len(classes) < 2:
        return rows.withColumn("score", F.coalesce("label", F.lit(0.0))).filter(F.col("score") >= accept).select("id", "key", "at", "value", "name", "score")
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(gather.transform(train))
    scored = forest.transform(gather.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.filter(F.col("score") >= accept).select("id", "key", "at", "value", "name", "score")


def redacted(docs: DataFrame, findings: DataFrame, id_col="doc_id", text_col="text", mark="[SECRET]") -> DataFrame:
    """`docs` with each finding's value replaced in its text."""
    values = findings.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias("found"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("of"), F.xxhash64(F.col(text_col)).alias("named"), F.col(text_col).alias("text"))
    text = F.aggregate("found", F.col("text"), lambda t, x: F.replace(t, x["value"], F.lit(mark)))
    rows = rows.join(values.hint("shuffle_hash"), F.col("of").eqNullSafe(F.col("id")) & (F.col("named") == F.col("key")), "left")
    rows = rows.withColumn("text", F.when(F.col("found").isNotNull(), text).otherwise(F.col("text")))
    return rows.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("at").alias("word_at"), F.length("value").alias("chars"), F.sha2("value", 256).alias("value_sha256"), "score")
