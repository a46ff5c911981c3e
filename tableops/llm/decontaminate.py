"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

A text's words are its lower-cased runs of letters and digits; a shingle is five of them. A
window is a place in a document that is as long as a benchmark item.

*Windows.* Wherever a document and an item have a shingle in common, the item is laid over the
document with the two shingles on each other, and the words it covers are a window (cut at the
document's ends). Every shingle of every item is laid on every equal one of every document, so a
place that is left out has none of the item's shingles where the item has it.

*Weights.* A shingle of an item weighs one over the number of different item texts that have it: text
that many items share says little, an item that stands in the benchmark twice loses nothing. All
other shingles of a window weigh as much as what they stand for: in the fingerprint the mean of the
window's known shingles, in the check the mean of the item's shingles that the window lacks.

*Fingerprints.* Bit i of a window's 64-bit SimHash is the majority of bit i of its shingles'
hashes, each counted with the square root of its weight, so that two fingerprints differ the less,
the more alike their weighted sets are. Equal windows, as copies of a passage make them, are
fingerprinted once.

*Blocks.* The fingerprints are cut into ``radius + 1`` blocks. Two fingerprints that differ in at
most ``radius`` bits agree on a whole block, so windows meet items of their length on (length,
block number, block) and no pair within the radius is missed. The radius follows from the
threshold (``radius_for``): four standard deviations above the bits in which pairs at the threshold
differ on average, 21 of 64 for 80 %.

*Check.* Candidates are compared exactly: shingles count as often as they occur, and the weight
in common must be 80 % of the weight of both together. Weights are whole millionths, so sums do
not depend on the order.

Defined results: missing and empty texts, and texts and items of fewer than five words, match
nothing. Rows that repeat an id are judged one by one by their text; rows that repeat id and
text give one row. An item id that occurs twice stands for both texts; a text under two ids is found
for both. Ties between places go to the earliest. Other columns, whatever their names, are ignored or passed through.

The items' shingles are broadcast as long as they are few (``frames.MOST_SENT``); beyond that the
join is left to Spark. It carries a shingle and its place; the words of a window are fetched from
its document afterwards, once for each window.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.frames import free_name, sent_if_small
from tableops.plans.scratch import written

SIZE = 5
#: The weight of a shingle that one item text has.
WHOLE = 1_000_000


def radius_for(least: int) -> int:
    """The bits within which fingerprints of pairs that are alike to ``least`` % lie, but for about one in 30,000."""
    alike = least / 100
    apart = math.acos(2 * alike / (1 + alike)) / math.pi
    return min(31, round(64 * apart + 4 * math.sqrt(64 * apart * (1 - apart))))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """A hash for each run of five words; none if there are fewer.

    The words are bound to a lambda variable, so that they are split off once and not for each use.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - SIZE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SIZE)]))

    return F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) >= SIZE), hashes))


def _fingerprints(counted: DataFrame, key: str) -> DataFrame:
    """SimHash of each key's shingles ``h``, of ``often`` and ``weight`` each: key, fingerprint."""
    size = F.col("often") * F.sqrt("weight").cast("long")
    ones = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * size).alias(f"b{b}") for b in range(64)]
    summed = counted.groupBy(key).agg(F.sum(size).alias("all"), *ones)
    bits = [F.shiftleft((F.col(f"b{b}") * 2 > F.col("all")).cast("long"), b) for b in range(64)]
    return summed.select(key, reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def _blocks(radius: int) -> Column:
    """The blocks of a fingerprint: an array of their values, each marked with its number."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) + F.lit(i << 40) for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*parts)


def found(docs: DataFrame, benchmark: DataFrame, least: int = 80, radius: int | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where documents hold benchmark items: id, print (hash of id and text), item, similarity, start and length in words."""
    radius = radius_for(least) if radius is None else radius
    named = benchmark.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") >= SIZE)
    named = written(named.select("item", F.xxhash64("w").alias("iid"), "w").distinct(), "items")
    texts = named.groupBy("iid").agg(F.first("w").alias("w"))
    texts = written(texts.select("iid", F.size("w").alias("length"), shingles(F.col("w")).alias("h")), "texts")
    placed = texts.select("iid", "length", F.posexplode("h").alias("at", "h"))
    weights = placed.groupBy("h").agg(F.floor(WHOLE / F.count_distinct("iid")).cast("long").alias("weight"))
    weights = written(weights, "weights")
    anchors = written(placed.select("h", "at", "length").distinct(), "anchors")

    mark = F.xxhash64(F.col(doc_id), F.col(text))
    own = docs.select(F.col(doc_id).alias("id"), mark.alias("print"), shingles(words(F.col(text))).alias("all"))
    hits = own.select("id", "print", F.size("all").alias("size"), F.posexplode("all").alias("place", "h")).join(sent_if_small(anchors), "h")
    start = F.greatest(F.col("place") - F.col("at"), F.lit(0))
    end = F.least(F.col("place") - F.col("at") + F.col("length") - SIZE + 1, F.col("size"))
    spans = written(hits.select("id", "print", "length", start.alias("start"), end.alias("end")).distinct(), "spans")
    inside = F.slice("all", F.col("start") + 1, F.col("end") - F.col("start"))
    windows = spans.join(own.select("print", "all"), "print").select("id", "print", "length", "start", "end", inside.alias("content"))
    windows = written(windows.withColumn("wid", F.xxhash64("length", "content")), "windows")

    contents = windows.groupBy("wid", "length").agg(F.first("content").alias("content"))
    contents = written(contents, "contents")
    apart = contents.select("wid", F.explode("content").alias("h")).groupBy("wid", "h").agg(F.count("*").alias("often"))
    window_counts = written(apart.join(sent_if_small(weights), "h", "left"), "counts")
    item_counts = placed.groupBy("iid", "h").agg(F.count("*").alias("often")).join(sent_if_small(weights), "h")
    item_counts = written(item_counts, "counts")
    known = window_counts.groupBy("wid").agg(F.floor(F.sum(F.col("often") * F.col("weight")) / F.sum(F.when(F.col("weight").isNotNull(), F.col("often")))).alias("mean"))
    weighed = window_counts.join(known, "wid").select("wid", "h", "often", F.coalesce("weight", "mean").alias("weight"))
    by_window = _fingerprints(weighed, "wid").join(contents.select("wid", "length"), "wid")
    by_item = _fingerprints(item_counts, "iid").join(texts.select("iid", "length"), "iid")
    left = by_window.select("wid", "length", "fingerprint", F.explode(_blocks(radius)).alias("block"))
    right = by_item.select("iid", "length", F.col("fingerprint").alias("other"), F.explode(_blocks(radius)).alias("block"))
    near = left.join(right, ["length", "block"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius)
    near = written(near.select("wid", "iid").distinct(), "near")

    both = F.least("often", "other")
    common = near.join(window_counts.drop("weight"), "wid").join(item_counts.select("iid", "h", "weight", F.col("often").alias("other")), ["iid", "h"])
    common = common.groupBy("wid", "iid").agg(F.sum(both * F.col("weight")).alias("common"), F.sum(both).alias("shared"))
    totals = item_counts.groupBy("iid").agg(F.sum(F.col("often") * F.col("weight")).alias("item_weight"), F.sum("often").alias("item_size"))
    sizes = contents.select("wid", F.size("content").alias("window_size"))
    # A window is never longer than its item, so it never has more shingles of its own than it lacks.
    lacks, strange = F.col("item_size") - F.col("shared"), F.col("window_size") - F.col("shared")
    union = F.col("item_weight") + F.when(lacks > 0, F.floor((F.col("item_weight") - F.col("common")) * strange / lacks)).otherwise(0)
    alike = common.join(totals, "iid").join(sizes, "wid").withColumn("union", union).where(F.col("common") * 100 >= F.col("union") * least)
    alike = alike.join(texts.select("iid", F.col("length").alias("words")), "iid").join(named.select("iid", "item"), "iid")
    alike = written(alike.select("wid", "item", "words", (F.col("common") / F.col("union")).alias("similarity")), "alike")

    places = windows.select("id", "print", "start", "wid").join(sent_if_small(alike), "wid")
    best = places.groupBy("id", "print", "item").agg(F.max(F.struct("similarity", -F.col("start"), "words")).alias("best"))
    return best.select("id", "print", "item", F.col("best.similarity").alias("similarity"), (-F.col("best")["col2"]).alias("start"), F.col("best.words").alias("words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they were."""
    leaks = written(found(docs, benchmark, doc_id=doc_id, text=text).select("print").distinct(), "leaks")
    key = free_name(docs, "print")
    marked = docs.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text)))
    return marked.join(sent_if_small(leaks.withColumnRenamed("print", key)), key, "left_anti").select(*docs.columns)
