"""Building blocks that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.matching import (
    PIECE, Patterns, bytes_and_bounds, gram_slots, words_at_every_byte)
from graphloom.session import bytes_of, checkpoint, stage

BROADCAST_ROWS = 100_000
DEFAULT_SALTS = 8


def row_bound(df: DataFrame) -> int | None:
    """The optimiser's proven upper bound on the row count, or None.

    Literal relations, limits and global aggregates have one; scans do not.
    """
    try:
        bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    except AttributeError:  # a remote session exposes no plan
        return None
    return int(bound.get()) if bound.isDefined() else None


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side whose row count is proven small.

    Any other side is returned as it is: the join then shuffles, and AQE decides
    from measured sizes whether to broadcast it or to split hot partitions.
    """
    bound = row_bound(df)
    return F.broadcast(df) if bound is not None and bound <= max_rows else df


def splits_hot_partitions(spark: SparkSession) -> bool:
    """Whether AQE splits oversized join partitions at run time."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name, "true").lower() == "true" for name in names)


def skewed_join(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner",
                salts: int | None = None, salt_by: Sequence[str] = ()) -> DataFrame:
    """Equi-join of a ``fact`` side with hot keys and a ``dim`` unique on ``on``.

    * A side that is proven small is broadcast, which needs no shuffle.
    * Otherwise, with AQE's skew join on, the join is left to it: from measured
      sizes it splits the fact's hot partitions, replicating only their dim rows.
    * Without it, or with ``salts`` given, the fact rows of a key are spread over
      ``salts`` partitions by a hash of ``salt_by`` and each dim row is replicated
      once per salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    dim_hinted = small(dim)
    fact_hinted = small(fact) if how == "inner" else fact
    if salts is None:
        salts = 1 if splits_hot_partitions(fact.sparkSession) else DEFAULT_SALTS
    if dim_hinted is not dim or fact_hinted is not fact or salts <= 1:
        return fact_hinted.join(dim_hinted, keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_by or fact.columns)]), F.lit(salts))
    left = fact.withColumn("_salt", salt.cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a small input whose few splits would leave cores idle.

    Inputs larger than one split per core are returned as they are: they have
    work for every core, and shuffling them would only cost.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session exposes no plan
        return df
    return df.repartition(cores) if size < cores * bytes_of(split) else df


def in_pieces(df: DataFrame, piece: int, most: int = 4096) -> DataFrame:
    """Deal a table out to tasks of about ``piece`` stored bytes each, one per core at least.

    For steps that sort wide rows made from narrow ones: a whole split of them would not fit
    a task's memory and spill. Rows are dealt by a hash of themselves, which needs no sort.
    Beyond ``most`` tasks pieces grow.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session exposes no plan
        return df
    return df.repartition(max(cores, min(most, -(-size // piece))), *df.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank", salts: int = 1) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based rank.

    ``row_number() <= n`` lets Spark cut each group to ``n`` rows before the
    shuffle (WindowGroupLimit), so a hot group sends at most n rows per map task. Where groups
    are few, ``salts`` lets so many tasks share what a group's map tasks have sent; the last
    task then ranks ``n`` rows of each. ``order`` must be total for the ranks to be certain.
    """
    if salts > 1:
        salted = df.withColumn("_salt", F.spark_partition_id() % salts)
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rank_in_salt", F.row_number().over(inner)).filter(
            F.col("_rank_in_salt") <= n).drop("_salt", "_rank_in_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def exact_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` within ``keys`` by ``order``, for groups of any size.

    A plain window sorts each group in one task. Here rows are range-partitioned
    by (keys, order), so a hot group spans many partitions; each partition ranks
    its own piece, and a piece's offset is the summed size of the group's earlier
    pieces. The range-partitioned rows are checkpointed, because the piece numbers
    must be the same for both readers. ``order`` must be total within a group.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = checkpoint(
        df.repartitionByRange(n, *keys, *order).withColumn("_piece", F.spark_partition_id())
    )
    group = [*keys, "_piece"]
    local = pieces.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    sizes = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    # At most ``n`` pieces per group: this window is bounded by the partition count.
    before = (
        Window.partitionBy(*keys).orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # Only groups that span several pieces need an offset: at most n rows remain.
    offsets = offsets.filter(F.col("_offset") > 0).drop("_size")
    renamed = {c: f"_k{i}" for i, c in enumerate(group)}
    offsets = offsets.withColumnsRenamed(renamed)
    cond = F.lit(True)
    for c, k in renamed.items():
        cond = cond & F.col(c).eqNullSafe(F.col(k))
    total = F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))
    return local.join(offsets, cond, "left").select(
        *df.columns, total.cast("bigint").alias(rank)
    )


def previous_in_order(df: DataFrame, keys: Sequence[str], order: Column, bucket: Column,
                      value: str, out: str) -> DataFrame:
    """``lag(value)`` within ``keys`` by ``order`` for groups of any size.

    ``bucket`` must be non-decreasing in ``order``. The lag is taken inside each
    (keys, bucket) piece; the first row of a piece takes the last value of the
    group's previous piece, found on one summary row per piece.
    """
    rows = df.withColumn("_ord", order).withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]
    inside = Window.partitionBy(*group).orderBy("_ord")
    rows = rows.withColumn("_prev", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    last = (
        df.withColumn("_ord", order).withColumn("_bucket", bucket)
        .groupBy(*group).agg(F.max_by(value, "_ord").alias("_last"))
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.withColumn("_carry", F.lag("_last").over(across)).drop("_last")
    joined = rows.join(carried, group, "left")
    return joined.withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    ).drop("_ord", "_bucket", "_prev", "_first", "_carry")


def lag_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                 partitions: int | None = None) -> DataFrame:
    """``lag(value)`` within ``keys`` by ``order`` for groups of any size.

    Rows are range-partitioned by (keys, order), so a hot group spans many tasks, however its
    order is spread. The lag is taken inside each piece; a group's first row of a piece takes
    the last value of the group's piece before, found on one summary row per group and piece,
    which skips pieces that the group does not reach. Repeated rows of one order follow each
    other in the order of ``value``. A table that is proven small is not cut.
    """
    order = [*order, *([value] if value not in order else [])]
    bound = row_bound(df)
    if bound is not None and bound <= BROADCAST_ROWS:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = checkpoint(
        df.repartitionByRange(n, *keys, *order).withColumn("_piece", F.spark_partition_id()))
    group = [*keys, "_piece"]
    inside = Window.partitionBy(*group).orderBy(*order)
    rows = pieces.withColumn("_prev", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1)
    # A struct, as the last value itself may be null.
    last = pieces.groupBy(*group).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    # At most ``n`` pieces per group: this window is bounded by the partition count.
    across = Window.partitionBy(*keys).orderBy("_piece")
    carried = last.withColumn("_carry", F.lag("_last").over(across)).filter(
        F.col("_carry").isNotNull()).drop("_last")
    renamed = {c: f"_k{i}" for i, c in enumerate(group)}
    cond = F.lit(True)
    for c, k in renamed.items():
        cond = cond & F.col(c).eqNullSafe(F.col(k))
    joined = rows.join(carried.withColumnsRenamed(renamed), cond, "left")
    found = F.when(F.col("_first"), F.col(f"_carry.{value}")).otherwise(F.col("_prev"))
    return joined.select(*df.columns, found.alias(out))


def substring_pairs(texts: DataFrame, text: str, patterns: DataFrame, pattern: str,
                    few: int = 1_000, gram: int = 4) -> DataFrame:
    """All (text row, pattern row) pairs where the pattern occurs in the text.

    Up to ``few`` patterns (counted first, of 256 characters on average at most) go to
    every task as one array, and each text is tested in place: linear in the text, no
    shuffle. More patterns go through an inverted index of grams (:func:`indexed_pairs`).
    """
    t, p = F.col(text), F.col(pattern)
    filled = patterns.filter(F.length(p) > 0)
    listed = short_list(filled, pattern, few)
    if listed is not None:
        inside = F.filter("_all", lambda x: F.contains(t, x[pattern]))
        return texts.withColumn("_all", listed).select(
            *texts.columns, F.explode(inside).alias("_pattern")).select(
            *texts.columns, "_pattern.*")
    return indexed_pairs(texts, text, filled, pattern, gram)


def short_list(patterns: DataFrame, pattern: str, few: int = 1_000) -> Column | None:
    """All rows as one array, when there are up to ``few`` of 256 characters on average."""
    known = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(pattern)).alias("chars")).first()
    if known["n"] > few or (known["chars"] or 0) > 256 * few:
        return None
    return patterns.agg(F.collect_list(F.struct(*patterns.columns)).alias("all")).scalar()


def grams_of(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct substrings of the given lengths, in time linear in the text."""
    def from_place(items: Column, place: int) -> Column:
        return F.slice(items, F.lit(place), F.size(items))

    chars = F.split(text, "")
    of_size = {1: chars}
    for n in range(2, max(sizes) + 1):
        # Two shorter grams side by side; past the end one of them is missing.
        half = n // 2
        of_size[n] = F.array_compact(F.zip_with(
            of_size[n - half], from_place(of_size[half], n - half + 1), lambda x, y: F.concat(x, y)))
    return F.array_distinct(F.concat(*[of_size[n] for n in sizes]))


def gram_index(texts: DataFrame, text: str, grams: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(_tid, _gram): which texts hold which of the wanted ``grams`` (_gram).

    A text is known by a digest here; its characters leave the task only as grams that some
    pattern has.
    """
    # Inlined first: the digest is then a column of its own, computed once for each text, and
    # the second generator drops the list of grams it explodes.
    both = F.struct(F.md5(text).alias("_tid"), grams_of(F.col(text), sizes).alias("_grams"))
    held = texts.select(F.inline(F.array(both))).select("_tid", F.explode("_grams").alias("_gram"))
    return skewed_join(held, grams, "_gram", "left_semi", salt_by=["_tid"]).distinct()


#: Hashed grams of all texts: half a megabyte of bits, whatever the texts.
SLOTS = 1 << 22
#: From this number of patterns on, those with a gram that no text has are ruled out first.
RULED_OUT_FROM = 200_000
#: Patterns that are left by then are looked for in place, so many of 32 bytes on average at a
#: time, in up to ``ROUNDS`` rounds.
FEW_LEFT = 1_000_000
ROUNDS = 8


def possible_patterns(texts: DataFrame, text: str, patterns: DataFrame, gram: int) -> DataFrame:
    """The rows of ``patterns`` (_pattern) of which some text holds every gram, and perhaps a few more.

    Tasks mark the grams (of up to ``gram`` bytes here) of their texts in ``SLOTS`` bits; the bits
    of all texts are sent to the tasks that filter the patterns. Grams that share a slot let a
    pattern through only.
    """
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(SLOTS, bool)
        for batch in batches:
            held, _ = bytes_and_bounds(batch.column(0))
            for i in range(0, len(held) - 8, PIECE):
                words = words_at_every_byte(held[i:i + PIECE + 8])
                for n in range(1, gram + 1):
                    marks[gram_slots(words, n, SLOTS)] = True
        bits = np.packbits(marks).view(np.int64)
        found = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(bits[found])], ["word", "bits"])

    words = texts.select(text).mapInArrow(marked, "word int, bits bigint").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(bits.view(np.uint8)).astype(bool)
        for batch in batches:
            held, bounds = bytes_and_bounds(batch.column(0))
            words, lengths = words_at_every_byte(held), np.diff(bounds)
            keep = np.ones(len(lengths), bool)
            for n in range(1, gram + 1):
                absent = np.concatenate([[0], np.cumsum(~marks[gram_slots(words, n, SLOTS)])])
                which = np.flatnonzero(lengths >= n if n == gram else lengths == n)
                starts, ends = bounds[:-1][which], bounds[1:][which]
                keep[which] = absent[ends - n + 1] == absent[starts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return patterns.select("_pattern").mapInArrow(possible, "_pattern string")


def patterns_within(texts: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """The rows of ``texts`` with every one of the distinct ``patterns`` (_pattern) in their text.

    The patterns are broadcast, and every text is read once for all of them.
    """
    found = patterns.toArrow().column("_pattern").combine_chunks()
    tables = texts.sparkSession.sparkContext.broadcast(Patterns(found).tables())
    names = texts.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("array<string>")
    def within(values: pa.Array) -> pa.Array:
        places = Patterns.of(tables.value).within(values)
        return pa.ListArray.from_arrays(places.offsets, names.value.take(places.values))

    return texts.select(*texts.columns, F.explode(within(text)).alias("_pattern"))


def indexed_pairs(texts: DataFrame, text: str, patterns: DataFrame, pattern: str,
                  gram: int = 4) -> DataFrame:
    """The pairs of :func:`substring_pairs` for many patterns, none of them empty.

    Of very many patterns those with a gram that no text has are ruled out first. Up to ``ROUNDS``
    times ``FEW_LEFT`` others are looked for in place, and more through an index: a pattern is
    looked up by its rarest gram, by counted texts; the texts that hold it are fetched again, each
    once with the patterns to verify, so no text is in an exploded row. Grams have ``gram``
    characters, or are the whole of a shorter pattern.
    """
    known = stage(patterns.select(F.col(pattern).alias("_pattern")).distinct(), "patterns")
    numbers = (F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_pattern")).alias("bytes"),
               F.collect_set(F.least(F.length("_pattern"), F.lit(gram))).alias("sizes"))
    left = known.agg(*numbers).first()
    if left["n"] >= RULED_OUT_FROM:
        known = stage(possible_patterns(texts, text, known, gram), "possible-patterns")
        left = known.agg(*numbers).first()
    if left["n"] <= ROUNDS * FEW_LEFT and (left["bytes"] or 0) <= 32 * ROUNDS * FEW_LEFT:
        rounds = max(1, -(-left["n"] // FEW_LEFT), -(-(left["bytes"] or 0) // (32 * FEW_LEFT)))
        of_round = F.pmod(F.xxhash64("_pattern"), F.lit(rounds))
        hits = reduce(DataFrame.unionByName, [
            patterns_within(texts, text, known.filter(of_round == i)) for i in range(rounds)])
        named = stage(skewed_join(patterns.withColumn("_pattern", F.col(pattern)), known, "_pattern",
                                  "left_semi"), "named-patterns")
        few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return hits.join(F.broadcast(named) if few else named, "_pattern").drop("_pattern")
    sizes = sorted(left["sizes"])
    longest = max(sizes)
    size = F.least(F.length("_pattern"), F.lit(longest))
    parts = F.transform(F.sequence(F.lit(1), F.length("_pattern") - size + 1),
                        lambda i: F.substring(F.col("_pattern"), i, size))
    of_pattern = stage(known.select("_pattern", F.explode(F.array_distinct(parts)).alias("_gram")),
                       "pattern-grams")
    index = stage(gram_index(texts, text, of_pattern.select("_gram").distinct(), sizes), "gram-index")
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no text has rules its pattern out.
    rarest = of_pattern.join(counts, "_gram", "left").groupBy("_pattern").agg(
        F.min_by("_gram", F.struct(F.coalesce("n", F.lit(0)), "_gram")).alias("_gram"))
    survivors = skewed_join(index, rarest, "_gram", "inner", salt_by=["_tid"])
    # As long as the patterns that share a text's rare grams.
    wanted = survivors.groupBy("_tid").agg(F.collect_list("_pattern").alias("_patterns"))
    again = skewed_join(texts.withColumn("_tid", F.md5(text)), wanted, "_tid", "inner")
    inside = F.filter("_patterns", lambda x: F.contains(F.col(text), x))
    hits = again.select(*texts.columns, F.explode(inside).alias("_pattern"))
    return skewed_join(hits, patterns.withColumn("_pattern", F.col(pattern)), "_pattern", "inner").drop(
        "_pattern")
