"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

A window of a document is as long as a benchmark item and begins where the item would,
judging by a shingle that both have: a window that is similar to an item shares one, so no
other window can matter. Windows and items get 64-bit SimHash fingerprints of their
shingles. A multi-index finds all items within ``RADIUS`` bits of a window: fingerprints are
cut into four blocks of 16 bits, of which at least one differs in at most ``RADIUS // 4`` bits.
The index holds every block of every item with all its neighbours at that distance (697 keys a
block for radius 15), so a window probes four keys, and about 4 % of unrelated items of its
length come with them. Candidates are verified by the larger of the exact
weighted and plain Jaccard similarities of their shingle sets. In the weighted one a shingle of
an item weighs one over the number of items that have it, a shingle the item lacks weighs one;
so it finds what is particular to an item, and the plain one edited copies of items that repeat.

Everything is built-in expressions: documents are split, their shingles exploded and hashed
in generated code and probed against the shingles of the benchmark, which are broadcast when
their counted size is small and joined by a shuffle otherwise. What goes on from there are
only the places that hit. No group is collected but the windows of one document and the
shingles of one item, and a passage in very many documents costs one window in each.

Words are lower-cased runs outside ``[\\x20\\x09-\\x0D]``. Defined cases: an item shorter than
a shingle is found in texts that consist of it; null and empty texts and items match nothing;
rows that repeat an id are judged by their own text, and the id is reported once per item;
without a benchmark or documents there are no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, fresh, pick
from graphloom.session import configure, stage

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 4
BLOCK_BITS = BITS // BLOCKS
#: At similarity 0.8 fingerprints differ in 9.7 bits on average, with deviation 2.9.
RADIUS = 15


def words_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The words of a text; fewer than a shingle are filled up with empty ones."""
    words = F.array_remove(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    lack = F.greatest(F.lit(shingle) - F.size(words), F.lit(0))
    return F.when(F.size(words) > 0, F.concat(words, F.array_repeat(F.lit(""), lack))).otherwise(words)


def shingle_words(words: Column, shingle: int) -> Column:
    """The shingles of a word array as structs of their words."""
    count = F.greatest(F.size(words) - (shingle - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, i + 1, count).alias(f"w{i}") for i in range(shingle)])


def shingle_hash(struct: Column, shingle: int) -> Column:
    return F.xxhash64(*[struct[f"w{i}"] for i in range(shingle)])


def exploded(df: DataFrame, keys: list[str], shingle: int) -> DataFrame:
    """A row per shingle: the keys, pos and hash."""
    return df.select(*keys, F.posexplode(shingle_words(F.col("words"), shingle)).alias(
        "pos", "s")).select(*keys, "pos", shingle_hash(F.col("s"), shingle).alias("hash"))


def simhash(hashes: Column) -> Column:
    """A bit is one where most of the hashes have it set."""
    def bit(b: int) -> Column:
        ones = F.filter(hashes, lambda h: F.shiftrightunsigned(h, b) % 2 != 0)
        return F.when(F.size(ones) * 2 > F.size(hashes),
                      F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return reduce(Column.bitwiseOR, [bit(b) for b in range(BITS)])


def blocks_of(fingerprint: Column) -> Column:
    """The blocks of a fingerprint, each with its number in the bits above."""
    mask = F.lit((1 << BLOCK_BITS) - 1).cast("bigint")
    return F.array(*[
        (F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(mask)
         + F.lit(i << BLOCK_BITS)).cast("int") for i in range(BLOCKS)])


def neighbour_blocks(fingerprint: Column, radius: int) -> Column:
    """All blocks of which a fingerprint within ``radius`` bits has at least one.

    Were all blocks to differ in more than ``radius // BLOCKS`` bits, the fingerprints would
    differ in more than ``radius``.
    """
    flips = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1)
             for bits in combinations(range(BLOCK_BITS), n)]
    # one literal that is folded, in place of hundreds that every later step would analyse
    flips = F.split(F.lit(" ".join(map(str, flips))), " ").cast("array<int>")
    return F.flatten(F.transform(blocks_of(fingerprint), lambda block: F.transform(
        flips, lambda flip: block.bitwiseXOR(flip))))


def benchmark_items(benchmark: DataFrame, item_id: str, text: str, shingle: int,
                    radius: int) -> DataFrame:
    """Per item: id, size (words), its distinct shingles with places and weights, fingerprint."""
    items = pick(benchmark, [item_id, text]).select(
        F.col(item_id).alias("item_id"), words_of(F.col(text), shingle).alias("words")
    ).filter(F.size("words") > 0).withColumn("size", F.size("words"))
    rows = stage(exploded(items, ["item_id", "size"], shingle), "item-shingles")
    weights = rows.groupBy("hash").agg((1 / F.countDistinct("item_id")).alias("weight"))
    per_item = rows.join(weights, "hash").groupBy("item_id", "size").agg(
        F.collect_set(F.struct("hash", "weight")).alias("shingles"),  # of one item
        F.collect_list(F.struct("hash", "pos")).alias("places"))
    finger = simhash(F.transform("shingles", lambda s: s["hash"]))
    return stage(per_item.withColumn("fingerprint", finger), "items")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
          similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start and words of the
    most similar window (the first of them), its similarity and fingerprint distance."""
    configure(docs.sparkSession)
    items = benchmark_items(benchmark, item_id, item_text, shingle, radius)
    docs = pick(docs, [doc_id, text]).select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"),
        words_of(F.col(text), shingle).alias("words"))
    places = stage(items.select("size", F.explode("places").alias("p")).select(
        "p.hash", (F.col("p.pos")).alias("offset"), "size").distinct(), "places")
    hits = exploded(docs, ["doc_id", "content"], shingle).join(
        broadcast_if_small(places, row_bytes=32), "hash")
    windows = stage(
        hits.select("doc_id", "content", (F.col("pos") - F.col("offset")).alias("start"), "size")
        .distinct().groupBy("doc_id", "content").agg(
            F.collect_list(F.struct("start", "size")).alias("windows")), "windows")  # of one text
    held = windows.agg(F.count(F.lit(1)), F.sum(F.size("windows"))).first()
    wanted = broadcast_if_small(
        windows.withColumnsRenamed({"doc_id": "_id", "content": "_content"}),
        rows=held[0] + (held[1] or 0), row_bytes=48)
    cut = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))
                    & (F.col("content") == F.col("_content"))).select(
        "doc_id", "words", F.explode("windows").alias("w")).select(
        "doc_id", "w.start", "w.size", F.slice(
            "words", F.greatest(F.col("w.start"), F.lit(0)) + 1,
            F.col("w.size") + F.least(F.col("w.start"), F.lit(0))).alias("words"))
    hashes = F.array_distinct(F.transform(
        shingle_words(F.col("words"), shingle), lambda s: shingle_hash(s, shingle)))
    windowed = stage(cut.select("doc_id", "start", "size", hashes.alias("hashes")), "window-shingles")
    keyed = windowed.withColumn("fingerprint", simhash(F.col("hashes"))).withColumn(
        "block", F.explode(blocks_of(F.col("fingerprint"))))
    index = items.select(
        "item_id", "size", F.col("fingerprint").alias("item_fingerprint"),
        F.explode(neighbour_blocks(F.col("fingerprint"), radius)).alias("block"))
    near = keyed.join(index, ["size", "block"]).withColumn(
        "distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))))
    near = near.filter(F.col("distance") <= radius).dropDuplicates(["doc_id", "start", "size", "item_id"])
    sets = items.select(F.col("item_id").alias("_item"), F.col("size").alias("_size"), "shingles")
    near = near.join(sets, F.col("item_id").eqNullSafe(F.col("_item"))
                     & (F.col("size") == F.col("_size")))

    def total(column: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, s: a + s["weight"])

    common = F.filter("shingles", lambda s: F.array_contains("hashes", s["hash"]))
    more = F.size("hashes") - F.size(common)
    value = F.greatest(total(common) / (total(F.col("shingles")) + more),
                       F.size(common) / (F.size("shingles") + more))
    found = near.select("doc_id", "item_id", "start", F.col("size").alias("n_words"), "distance",
                        value.alias("similarity")).filter(F.col("similarity") >= similarity - 1e-9)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("before"), "n_words", "distance")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.before")).alias("start"), "best.n_words",
                       "best.similarity", "best.distance").withColumnsRenamed(
        {"doc_id": doc_id, "item_id": item_id})


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  **options) -> DataFrame:
    """The documents in which no benchmark item was found."""
    leaked = fresh(docs, "_leaked")
    found = stage(leaks(docs, benchmark, doc_id=doc_id, **options).select(
        F.col(doc_id).alias(leaked)).distinct(), "leaked")
    return docs.join(broadcast_if_small(found, row_bytes=16),
                     F.col(doc_id).eqNullSafe(F.col(leaked)), "left_anti")
