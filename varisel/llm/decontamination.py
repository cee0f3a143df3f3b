"""Benchmark passages in documents.

Windows of an item's own size slide over a document; a window with its item's content is a leak.

1. A similarity of s needs s of an item's m shingles (five words; of an item with fewer words, all of them), so a
window lacks fewer than m - ceil(s m) + 1 of them: of each item so many, those that fewest items share, are its
anchors, and only a document that has an anchor can leak the item. This passes over nothing.
2. In these documents all shared shingles are placed. A window that starts at a shared
shingle, or as late as the document allows, shares as many as any: these are the windows, of the size of each item that shares. Those with under
half of the shared positions that the similarity needs, for every item of their size, are passed over, without loss. A window knows its place and size,
not its item.
3. The windows and the items get SimHash fingerprints: 64 votes over all shingles of a window.
4. Multi-index over all items: 64 bits fall into BLOCKS blocks. Of two fingerprints within the radius one block differs in at
most radius // BLOCKS bits, so an item is entered under all values so near to its own, with its size, and joining on (size, block,
value) finds every item within the radius of a window.
5. The exact weighted similarity of the multisets of shingles, sum of minima over sum of maxima, decides:
``similarity`` or more is a leak. The radius of 23 is wide: at a similarity of 0.8 fingerprints differ
in about 10 bits with a deviation of 3.

DataFrame functions only. Items' shingles are broadcast up to BROADCAST_SHINGLES rows, keys of documents
with windows up to BROADCAST_DOCUMENTS; beyond that they are joined by a shuffle. Items of equal text are one item,
the smallest id stands for them, so copies of an item add nothing.

Words are separated by blanks, letters count as lower case. Defined cases: items without id or words take no part;
null and empty documents have no windows; a document shorter than an item is one window; rows equal in
doc_id and text are one document here; a document without doc_id is reported with null; very long texts are
read whole; empty tables give no rows; other columns are not read."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, bind, free_names, written

BROADCAST_SHINGLES = 1_000_000
#: Keys of so many documents, 16 bytes each, are broadcast to filter the texts; more by a shuffle.
BROADCAST_DOCUMENTS = 1_000_000
LANES = 32
#: Blocks of a fingerprint.
BLOCKS = 8


def plain_words(text: Column) -> Column:
    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def shingles(words: Column, k: Column) -> Column:
    """Hashes of all runs of k words; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def votes(shingle: str = "shingle") -> list[Column]:
    """Sums over shingles, two bits in the halves of each: bit i in the lower, bit i + 32 in the upper."""
    return [F.sum(F.shiftrightunsigned(shingle, i).bitwiseAND(F.lit(0x0000000100000001))).alias(f"v{i}") for i in range(LANES)] + [F.count(F.lit(1)).alias("n_shingles")]


def simhash() -> Column:
    """The fingerprint from ``votes``: bits set in over half of the shingles."""
    low = lambda i: F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda i: F.shiftrightunsigned(f"v{i}", 32)
    bit = lambda n, i: F.when(2 * n > F.col("n_shingles"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    parts = [bit(low(i), i) for i in range(LANES)] + [bit(high(i), i + 32) for i in range(LANES)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def blocks(fp: str) -> Column:
    """(block, value) of a fingerprint's blocks."""
    width = 64 // BLOCKS
    value = lambda i: F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), value(i).alias("value")) for i in range(BLOCKS)])


def near_values(fp: str, radius: int) -> Column:
    """(block, value) of all values within radius // BLOCKS bits of those of a fingerprint's blocks."""
    width = 64 // BLOCKS
    flips = [sum(1 << i for i in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(width), n)]
    flip = F.array(*[F.lit(x).cast("long") for x in flips])
    return F.flatten(F.transform(blocks(fp), lambda b: F.transform(flip, lambda x: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(x).alias("value")))))


def within(prints: DataFrame, item_prints: DataFrame, radius: int) -> DataFrame:
    """Distinct prints (n, fp, …), item_prints (item_id, n, item_fp) -> prints with item_id and differing_bits, of all items of the same size within the radius."""
    index = item_prints.select("item_id", "n", "item_fp", F.explode(near_values("item_fp", radius)).alias("x")).select("item_id", "n", "item_fp", "x.*")
    met = prints.select(*prints.columns, F.explode(blocks("fp")).alias("x")).select(*prints.columns, "x.*").join(index, ["n", "block", "value"])
    apart, width = F.col("fp").bitwiseXOR(F.col("item_fp")), 64 // BLOCKS
    # a pair meets in every block that is near enough; its row of the first of these stays, so nothing is shuffled to tell them apart
    near = lambda i: F.bit_count(F.shiftrightunsigned(apart, width * i).bitwiseAND(F.lit((1 << width) - 1))) <= radius // BLOCKS
    first = F.coalesce(*[F.when(near(i), i) for i in range(BLOCKS)])
    met = met.filter(F.col("block") == first).withColumn("differing_bits", F.bit_count(apart))
    return met.filter(F.col("differing_bits") <= radius).select(*prints.columns, "item_id", "differing_bits")


def few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_DOCUMENTS else keys


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n, k, items' shingles: one row for each distinct text."""
    one = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), plain_words(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    one = one.groupBy("words").agg(F.min("item_id").alias("item_id"))
    n = F.size("words")
    return one.select("item_id", n.alias("n"), F.least(n, F.lit(5)).alias("k"), shingles(F.col("words"), F.least(n, F.lit(5))).alias("shingles"))


def anchors(spread: DataFrame, similarity: float) -> DataFrame:
    """Of each item the shingles that fewest items share, as many as no window of the similarity can lack."""
    shared = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("items")).select(F.col("shingle").alias("of"), "items")
    order = Window.partitionBy("item_id").orderBy("items", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("times").over(order), F.lit(0))
    ranked = spread.join(shared, F.col("shingle") == F.col("of")).withColumn("before", before)
    return ranked.filter(F.col("before") <= F.col("m") - F.ceil(F.lit(similarity) * F.col("m") - 1e-9)).select("item_id", "k", "shingle")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 23) -> DataFrame:
    """For each leaking document and item its most similar window: doc_id, item_id, start (word), h, n_shingles, shared
    and total weight of shingles, similarity, differing_bits."""
    items = written(items_of(benchmark), "items")
    spread = written(items.select("item_id", "n", "k", F.size("shingles").alias("m"), F.explode("shingles").alias("shingle")).groupBy("item_id", "n", "k", "m", "shingle").agg(F.count(F.lit(1)).alias("times")), "shingles")
    small = spread.count() <= BROADCAST_SHINGLES
    sized = [r.k for r in items.select("k").distinct().collect()]  # 1 to 5
    maybe = lambda df: F.broadcast(df) if small else df
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    rare = anchors(spread, similarity)

    def positions(k: int, df: DataFrame) -> DataFrame:
        both = bind(plain_words(F.col("text")), lambda w: F.struct(F.size(w).alias("w"), shingles(w, F.lit(k)).alias("s")))
        return df.withColumn("x", both).select("doc_id", "h", F.lit(k).alias("k"), F.col("x.w").alias("size"), F.col("x.s").alias("s"))

    pairs = [positions(k, texts).select("doc_id", "h", F.explode("s").alias("shingle")).join(maybe(rare.filter(F.col("k") == k).drop("k")), "shingle").select("doc_id", "h", "item_id") for k in sized or [5]]
    pairs = written(reduce(DataFrame.union, pairs).distinct(), "pairs")
    wanted = pairs.select(F.col("doc_id").alias("w_doc"), F.col("h").alias("w_h")).distinct()
    found = texts.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("h") == F.col("w_h")), "left_semi").dropDuplicates(["doc_id", "h"])
    arrays = written(reduce(DataFrame.union, [positions(k, found) for k in sized or [5]]), "arrays")
    own = arrays.select("doc_id", "h", "k", "size", F.posexplode("s").alias("p", "shingle")).join(maybe(spread), ["shingle", "k"])
    asked = pairs.select(F.col("doc_id").alias("w_doc"), F.col("h").alias("w_h"), F.col("item_id").alias("w_item"))
    asked_of = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("h") == F.col("w_h")) & (F.col("item_id") == F.col("w_item"))
    hits = written(own.join(asked, asked_of, "left_semi").select("doc_id", "h", "size", "p", "shingle", "item_id", "n", "k", "m", "times"), "hits")
    of = ["doc_id", "h", "item_id"]
    # shared positions in the window that starts here; the last window starts where the document allows
    start = F.greatest(F.least(F.col("p"), F.col("size") - F.col("n")), F.lit(0))
    windows = hits.withColumn("start", start).select(*of, "n", "k", "m", "size", "start").distinct()
    length = F.least("n", "size")
    windows = windows.withColumn("stop", F.col("start") + length - F.col("k"))  # the last shingle's place
    # counts of shared positions before each place, by place, and at the window's end
    marks = hits.select(*of, F.col("p").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("side"))
    asks = windows.select(*of, F.col("start").alias("at"), F.lit(0).alias("one"), "start", F.lit(-1).alias("side"))
    ends = windows.select(*of, F.col("stop").alias("at"), F.lit(0).alias("one"), "start", F.lit(1).alias("side"))
    running = F.sum("one").over(Window.partitionBy(*of).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    counted = marks.union(asks).union(ends).withColumn("running", running).filter("start is not null")
    held = counted.groupBy(*of, "start").agg((F.max("running") - F.min("running")).alias("held"))
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
    windows = windows.join(held, same(windows, held, [*of, "start"])).select(*[windows[c] for c in windows.columns], "held")
    placed = ["doc_id", "h", "n", "k", "m", "start", "stop"]
    windows = written(windows.filter(F.col("held") >= F.lit(similarity / 2) * F.col("m")).select(*placed).distinct(), "windows")

    # SimHash over all shingles of the windows that are left
    own = arrays.select(F.col("doc_id").alias("a_doc"), F.col("h").alias("a_h"), F.col("k").alias("a_k"), "s")
    met = windows.join(own, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("h") == F.col("a_h")) & (F.col("k") == F.col("a_k")))
    met = met.select(*placed, F.explode(F.slice("s", F.col("start") + 1, F.col("stop") - F.col("start") + 1)).alias("shingle"))
    prints = written(met.groupBy(*placed).agg(*votes()).select(*placed, "n_shingles", simhash().alias("fp")), "prints")
    item_prints = items.select("item_id", "n", F.explode("shingles").alias("shingle")).groupBy("item_id", "n").agg(*votes()).select("item_id", "n", simhash().alias("item_fp"))
    near = within(prints, item_prints, radius).drop("n", "k", "fp")  # rows are many here, so they carry what is still read

    # exact: minima over the shared shingles of a window
    shared = hits.select(*of, "p", "shingle", "times")
    inside = same(near, shared, of) & (shared["p"] >= near["start"]) & (shared["p"] <= near["stop"])
    met = near.join(shared, inside).select(*[near[c] for c in near.columns], "shingle", "times")
    mins = met.groupBy(*near.columns, "shingle", "times").agg(F.count(F.lit(1)).alias("here")).groupBy(*near.columns).agg(F.sum(F.least("here", "times")).alias("shared"))
    exact = mins.withColumn("total", F.col("m") + F.col("n_shingles") - F.col("shared")).withColumn("similarity", F.col("shared") / F.col("total"))
    best = Window.partitionBy(*of).orderBy(F.desc("similarity"), "start")
    out = exact.filter(F.col("similarity") >= similarity).withColumn("r", F.row_number().over(best)).filter("r = 1")
    return out.select("doc_id", "item_id", F.col("start").cast("long"), "h", "n_shingles", "shared", "total", "similarity", F.col("differing_bits").cast("int"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 23) -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    leak_doc, leak_hash = free_names(docs, "leak_doc", "leak_hash")
    found = leaks(docs, benchmark, similarity, radius).select(F.col("doc_id").alias(leak_doc), F.col("h").alias(leak_hash)).distinct()
    found = few(written(found, "leaks"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(leak_doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(leak_hash))
    return docs.join(found, same, "left_anti")
