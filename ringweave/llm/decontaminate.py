"""Benchmark decontamination by template canonicalisation.

Words (runs of ASCII letters and digits and of all other bytes above ASCII) are
lower-cased; a word with a digit or a number word becomes NUM, a unit after it
UNIT, and a capitalised word inside a sentence NAME. A template window is a run
of WINDOW such tokens. Windows of documents and benchmark are hash-joined; a hit
of an item in a document is a set of windows at one alignment that covers
NEED windows, or half of the item's (of its templates, if it has any) if those are
fewer, and of which as many have
the item's own values, whatever the others hold, or all have consistent slots:
equal values in the item stand for equal values in the document and the other
way round. Hits with other values than the item's are re-parameterised ones.

A template with fewer than WORDS plain words would match by chance, and capitals
decide what counts as a name. So each window is joined by its lower-cased words as
they stand, too: that finds verbatim copies of items full of numbers, and copies in
other capitals.

Before the join, documents' windows pass a bitmap of the benchmark's, of fixed
size, so only a few reach Spark's shuffle whatever the corpus holds.

Defined results: null and empty texts and items have no windows; an item with
fewer tokens than WINDOW is one window of its own, below LEAST tokens it isn't
searched, as such few words occur by chance; rows with the same id are told apart
by their text; an empty benchmark gives no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, stored, utf8
from .words import U, Words, mix, windows

WINDOW, LEAST, WORDS, NEED = 8, 5, 3, 6
BITS = 22
#: Benchmark windows up to here are broadcast; beyond, the join shuffles.
BROADCAST = 500_000
PIECE = 1 << 20

# Words that stand for numbers and for units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees meter meters metre metres kilometer kilometers kilometre kilometres"

_MAP = np.full(256, 32, np.uint8)
_MAP[48:58] = np.arange(48, 58)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:|"]] = True
NUM, UNIT, NAME = U(1), U(2), U(3)


def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    return np.sort(Words(data, np.array([0, len(data)])).hash)


class Template:
    """tokens: canonical token by word; slot: words that a placeholder stands for; value: hashes of the words themselves."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(_MAP[data], offsets)
        self.value = w.hash
        n = len(w.hash)
        self.tokens, self.slot = w.hash.copy(), np.zeros(n, bool)
        if not n:
            return
        first = data[w.first]
        second = data[np.minimum(w.first + 1, len(data) - 1)]
        capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        solid = np.where((data != 32) & (data != 9) & (data != 10) & (data != 13), np.arange(len(data)), -1)
        before = np.concatenate([[-1], np.maximum.accumulate(solid)])[w.first]
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        starts = np.zeros(n + 1, bool)
        starts[w.of] = True
        opens = starts[:n] | (before < 0) | _STOP[data[np.maximum(before, 0)]] | (lines[w.first] > lines[np.maximum(before, 0)])
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = (digits[w.past] > digits[w.first]) | np.isin(w.hash, _hashes(NUMBERS))
        unit = np.zeros(n, bool)
        unit[1:] = number[:-1] & np.isin(w.hash[1:], _hashes(UNITS)) & ~starts[1:n]
        name = capital & ~opens & ~number
        self.tokens[name], self.tokens[unit], self.tokens[number] = NAME, UNIT, NUM
        self.slot = name | unit | number

    def windows(self, size: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first words, names) of the windows of `size` tokens that lie in one text: of all by their words, or of those with enough plain words by their template."""
        n = len(self.tokens)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        if exact:
            own = np.repeat(np.arange(len(self.words.of) - 1), np.diff(self.words.of))
            at = np.flatnonzero(own[: n - size + 1] == own[size - 1 :])
            return at, mix(windows(mix(self.value), size)[at] ^ U(size))
        starts = np.zeros(n + 1, np.int64)
        starts[self.words.of] = 1
        text, slots = np.cumsum(starts[:n]), np.concatenate([[0], np.cumsum(self.slot)])
        at = np.flatnonzero((text[: n - size + 1] == text[size - 1 :]) & (slots[size:] - slots[:-size] <= size - min(WORDS, size)))
        return at, mix(windows(mix(self.tokens), size)[at] + U(size))


def _emit(sizes, bitmap, whole: bool):
    """Rows (id, key, text last): a row for each window, with its slots' places in it and values. whole: short texts are one window."""

    def run(batches):
        bits = bitmap.value if bitmap else None
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, PIECE):
                t = Template(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(t.words.of)
                for size, exact in [(s, e) for s in sizes for e in (False, True)]:
                    at, name = t.windows(size, exact)
                    text = np.searchsorted(t.words.of, at, "right") - 1
                    if whole:
                        keep = (n[text] == size) if size < WINDOW else np.ones(len(at), bool)
                    else:
                        keep = bits[(name >> U(64 - BITS)).astype(np.int64)]
                    at, name, text = at[keep], name[keep], text[keep]
                    if not len(at):
                        continue
                    slots = [[] if exact else t.value[x : x + size][t.slot[x : x + size]].view(np.int64).tolist() for x in at]
                    rows = pa.array(text + a)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(rows), batch.column("key").take(rows), pa.array(name.view(np.int64)), pa.array((at - t.words.of[text]).astype(np.int32)), pa.array(n[text].astype(np.int32)), pa.array(slots, pa.list_(pa.int64())), pa.array([exact] * len(at))],
                        ["id", "key", "name", "at", "n_words", "slots", "worded"],
                    )

    return run


def _windows(rows: DataFrame, id_col: str, text_col: str, sizes, bitmap=None, whole=False) -> DataFrame:
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_emit(sizes, bitmap, whole), "id long, key long, name long, at int, n_words int, slots array<long>, worded boolean")


def _exact(slots):
    return F.forall(slots, lambda x: x["item_slots"] == x["slots"])


def _consistent(found):
    """Whether the slots of some windows map one to one."""
    pairs = F.array_distinct(F.flatten(F.transform(found, lambda x: x["slots"])))
    both = [F.size(F.array_distinct(F.transform(pairs, lambda x: x[side]))) for side in ("item_slots", "slots")]
    return (both[0] == F.size(pairs)) & (both[1] == F.size(pairs))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """id, key (xxhash64 of the text), item_id, matched, windows, exact: the best alignment of each item that a document holds."""
    spark = docs.sparkSession
    items = stored(_windows(benchmark, item_col, item_text_col, range(LEAST, WINDOW + 1), whole=True), "bench-windows")
    bitmap = np.zeros(1 << BITS, bool)
    hit = items.select(F.shiftrightunsigned("name", 64 - BITS).cast("int").alias("bit")).distinct().toArrow()  # 2 ** BITS rows at most
    bitmap[hit.column("bit").to_numpy()] = True
    sizes = sorted({min(WINDOW, r[0]) for r in items.select(F.least("n_words", F.lit(WINDOW))).distinct().collect()})
    n_items = items.count()
    found = _windows(docs, id_col, text_col, sizes, spark.sparkContext.broadcast(bitmap))
    found = stored(found.select("id", "key", "name", "at", "slots"), "bench-found")
    per_item = items.groupBy(F.col("id").alias("item_id"), F.col("key").alias("item_key")).agg(F.countDistinct("at").alias("windows"), F.countDistinct(F.when(~F.col("worded"), F.col("at"))).alias("templates"))
    items = items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "name", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    pairs = found.join(items.hint("broadcast" if n_items <= BROADCAST else "merge"), "name").filter(F.size("slots") == F.size("item_slots"))
    same = F.arrays_zip("item_slots", "slots")
    hits = pairs.groupBy("id", "key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.countDistinct("item_at").alias("matched"), F.collect_set(F.struct("item_at", same.alias("slots"))).alias("found"))
    per_item = per_item.hint("broadcast" if n_items <= BROADCAST else "merge")
    hits = hits.join(per_item, hits.item_id.eqNullSafe(per_item.item_id) & (hits.item_key == per_item.item_key)).select(hits["*"], "windows", "templates")
    hits = hits.withColumn("need", F.least(F.lit(NEED), F.ceil(F.coalesce(F.nullif("templates", F.lit(0)), "windows") / 2)).cast("int")).filter(F.col("matched") >= F.col("need"))
    verbatim = F.size(F.array_distinct(F.transform(F.filter("found", lambda x: _exact(x["slots"])), lambda x: x["item_at"])))
    hits = hits.filter((verbatim >= F.col("need")) | _consistent(F.col("found"))).withColumn("exact", verbatim == F.col("matched"))
    best = F.max(F.struct("matched", "exact", "windows")).alias("best")
    return hits.groupBy("id", "key", "item_id").agg(best).select("id", "key", "item_id", F.col("best.matched").alias("matched"), F.col("best.windows").alias("windows"), F.col("best.exact").alias("exact"))


def without(docs: DataFrame, hits: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """`docs` without the rows that have a hit."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("of"), F.xxhash64(F.col(text_col)).alias("named"))
    gone = hits.select("id", "key").distinct().hint("shuffle_hash")
    return rows.join(gone, F.col("of").eqNullSafe(F.col("id")) & (F.col("named") == F.col("key")), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    hits = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(F.col("id").alias("doc_id"), "item_id", "matched", "windows", "exact")
