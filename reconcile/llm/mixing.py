"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The words of all sources are dealt out in slots of equal length. Slot i falls at
the golden-ratio point frac(i / phi) of the targets laid end to end, so every
stretch of the schedule holds each source in its proportion. The slots of a
source are ranked; rank r takes block r of the source's words, its documents in
an order shuffled by a hash, read round and round. The mix ends with the slot that
fills the targets: what it takes of a source is the blocks that its points have drawn
by then, so a source comes as near its target as the points are even. Only where a
source has no more to give are its slots void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reconcile.llm.storage import cut, few, salted_lookup

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
GOLDEN = (5**0.5 - 1) / 2
#: Slots in the schedule until a block has BLOCK_WORDS words; more slots from there on.
SLOTS, BLOCK_WORDS = 1 << 20, 4096
#: Parts of the unit interval by which points meet the sources; shuffle chunks of a source; slots of a rank chunk.
CELLS, CHUNKS, RANKED = 4096, 4096, 8192


def word_count(text: str | Column) -> Column:
    """Runs of characters other than blank, tab, line feed, VT, FF and CR; 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.size(F.split(trimmed, "[ \\t-\\r]+"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(words).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sid, source, source_size, weight, target of each source, from (source, size).

    The sources in code point order, null last, weigh ``weights`` in turn and
    share the sum of all sizes; no target passes ``most`` times its source's size.
    """
    everything = Window.partitionBy()  # the sources only, one row each
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    )
    # Below the first source that its share fits, every source is full; that share per weight holds for the rest.
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct(F.col("cap") / F.col("weight"), "sid")))
    share = F.coalesce(level.over(everything), F.lit(0.0)) * F.col("weight")
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), share))
    return sources.select("sid", "source", "source_size", "weight", "target")


def _plan(sources: DataFrame, slots: int, block_words: int, most: int) -> DataFrame:
    """sources with the words taken of each, the block length and the ends of its part of the unit interval."""
    everything = Window.partitionBy()
    along = everything.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("source_size").over(everything)
    block = F.least(F.greatest(F.ceil(total / F.lit(slots)), F.lit(1)), F.lit(block_words)).cast("long")
    return (
        sources.withColumn("block", block)
        .withColumn("ranks", F.ceil(F.col("source_size") * most / F.col("block")))
        .withColumn("all_slots", F.ceil(F.sum("target").over(everything) / F.col("block")))
        .withColumn("high", F.sum("target").over(along) / F.sum("target").over(everything))
        .withColumn("low", F.coalesce(F.lag("high").over(everything.orderBy("sid")), F.lit(0.0)))
        .withColumn("high", F.when(F.lead("sid").over(everything.orderBy("sid")).isNull(), 2.0).otherwise(F.col("high")))
    )


def schedule(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """slot, sid, rank: which block of which source each slot of the mix takes.

    Slots past a source's last block are void.
    """
    (last,) = plan.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()  # one number
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(last).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    cells = F.sequence(F.floor(F.col("low") * CELLS).cast("long"), F.least(F.floor(F.col("high") * CELLS).cast("long"), F.lit(CELLS)))
    parts = plan.select("sid", "ranks", "low", "high", F.explode(cells).alias("cell"))
    drawn = points.join(parts, "cell").where("u >= low AND u < high").select(
        "slot", "sid", "ranks", F.floor(F.col("slot") / RANKED).alias("chunk")
    )
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    starts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(starts, ["sid", "chunk"])
    return ranked.select("slot", "sid", (F.col("start") + F.col("inside")).alias("rank"), "ranks").where("rank < ranks").drop("ranks")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, slots: int = SLOTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slots of every row of docs (doc_id, text, source).

    ``taken`` counts the words of the row in the blocks that the schedule's slots
    drew, repeats counted: at most ``most`` times its size. ``slots`` holds, for each time that the
    mix comes to the row, the slot where it does, in order. A row without words takes none. Repeated
    rows count as different documents, a null source is a source of its own, an
    empty table gives an empty result; other columns are ignored.
    """
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size")))  # the texts are read once
    plan = cut(_plan(source_targets(sized, weights, most), slots, block_words, most))
    drawn = cut(schedule(docs.sparkSession, plan))
    got = drawn.groupBy("sid").agg(F.count("*").alias("got"))
    taken_of_source = F.least(F.coalesce("got", F.lit(0)) * F.col("block"), F.col("source_size") * most)
    plan = plan.join(got, "sid", "left").withColumn("take", taken_of_source)
    order = F.xxhash64(F.lit("mix"), "doc_id", "size")
    chunk = F.shiftrightunsigned(order, 64 - CHUNKS.bit_length() + 1)
    dealt = sized.withColumn("order", order).withColumn("chunk", chunk)
    dealt = salted_lookup(dealt, plan.select("source", "sid", "source_size", "target", "take", "block"), "source", F.col("order"))
    # Where each document starts in its shuffled source: chunk by chunk, so that no task holds a source.
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    sums = sums.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    shuffled = Window.partitionBy("sid", "chunk").orderBy("order", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside).withColumn("nth", F.row_number().over(shuffled)).join(sums, ["sid", "chunk"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inside"))
    # The stretches of the endlessly repeated source that are this document, by the blocks they lie in.
    turn = F.explode_outer(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (e * F.col("source_size") + F.col("start") < F.col("take")) & (F.col("size") > 0)))
    stretch = placed.withColumn("turn", turn).withColumn("from", F.col("turn") * F.col("source_size") + F.col("start"))
    stretch = stretch.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
    first, final = F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block"))
    pieces = stretch.withColumn("rank", F.explode_outer(F.when(F.col("turn").isNotNull(), F.sequence(first, final))))
    overlap = F.least("to", (F.col("rank") + 1) * F.col("block")) - F.greatest("from", F.col("rank") * F.col("block"))
    joined = pieces.join(drawn, ["sid", "rank"], "left")
    one = ["doc_id", "source", "size", "source_size", "target", "sid", "chunk", "nth"]
    # Within a turn first, then over the at most ``most`` turns.
    turns = joined.groupBy(*one, "turn").agg(F.sum(F.when(F.col("slot").isNotNull(), overlap)).alias("words"), F.min("slot").alias("slot"))
    taken, at = F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots")
    return turns.groupBy(*one).agg(taken, at).select("doc_id", "source", "size", "source_size", "target", "taken", "slots")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """docs, columns unchanged, each row as often as the mix takes it, in the order of the schedule.

    That is its words taken over its size, rounded (halves up): rows of an
    over-full source may go, those of a source below its target repeat. A repeat stands where the
    schedule comes to the row again.
    """
    key = F.xxhash64("doc_id", "text", "source")
    taken = mix(docs.select(key.alias("doc_id"), "text", "source"), weights, most).groupBy(F.col("doc_id").alias("_row"))
    # Equal rows share what they are given.
    taken = taken.agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("slots").alias("_slots")).where("size > 0")
    times = F.expr("cast((2 * taken + size) div (2 * size) as int)")
    taken = cut(taken.select("_row", "_slots", times.alias("_times")).where("_times > 0"))
    joined = docs.join(few(taken), key == F.col("_row"))
    time = F.explode(F.sequence(F.lit(1), F.col("_times")))
    repeated = joined.withColumn("_time", time).withColumn("_slot", F.col("_slots")[F.least("_time", F.size("_slots")) - 1])
    return repeated.sort("_slot", "_row", "_time").drop("_row", "_times", "_time", "_slot", "_slots")
