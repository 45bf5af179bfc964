"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a few neighbouring words that may ignore some of them.
Documents and benchmark items are hashed at every position under every seed and joined on
the hashes; around each hit the two word sequences are laid over each other
and the longest stretch with enough equal words is measured, so that changed words
neither prevent the hit nor the proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reconcile.llm.storage import cut, few, salted_lookup
from reconcile.llm.tokens import Words, sequence_hash, slices

#: Positions that count. One of them hits wherever a fifth of the words or less are changed: in a short item
#: anywhere, in a stretch of any other length but at its ends. The tests go through all patterns.
SEEDS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Words that an overlap must have (or all of a shorter item that has SHORTEST), and percent of them that are equal.
OVERLAP, SHORTEST, EQUAL = 13, 8, 80
#: The Bloom filter of benchmark hashes has 64 bits a hash, within these powers of two: 16 MB at most.
#: A hash sets the bits that it has from each of the places on.
FILTER_BITS, PLACES = (20, 27), (0, 12, 24, 36)


def seed_hashes(words: Words, seeds=SEEDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seed: positions where it lies within a row, and the hashes there."""
    rows = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found = []
    for number, seed in enumerate(seeds):
        last = len(rows) - seed[-1]
        if last <= 0:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        at = np.flatnonzero(rows[:last] == rows[seed[-1] :])
        found.append((at, sequence_hash([words.hashes[at + o] + np.uint64(number) for o in seed])))
    return found


def longest_overlap(equal: np.ndarray, percent: int = EQUAL) -> tuple[int, int, int]:
    """(start, length, equal words) of the longest stretch of which so many percent are equal."""
    if not equal.any():
        return 0, 0, 0
    heights = np.concatenate(([0], np.cumsum(np.where(equal, 100 - percent, -percent))))
    # A stretch begins and ends with an equal word; the first start that is no higher than the
    # end is found by bisection, as the least height of the starts so far only falls.
    lowest = np.minimum.accumulate(np.where(equal, heights[:-1], 101 * len(equal)))
    ends = np.flatnonzero(equal) + 1
    starts = np.searchsorted(-lowest, -heights[ends], side="left")
    longest = int((ends - starts).argmax())
    start, end = int(starts[longest]), int(ends[longest])
    return start, end - start, int(equal[start:end].sum())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in slices(batch.column(1)):
            words = Words(batch.column(1).slice(start, end - start))
            hashes: list[list[dict]] = [[] for _ in range(end - start)]
            rows = np.repeat(np.arange(end - start), np.diff(words.first))
            for at, names in seed_hashes(words):
                for p, h in zip(at.tolist(), names.view(np.int64).tolist()):
                    hashes[rows[p]].append({"hash": h, "at": p - int(words.first[rows[p]])})
            tokens = pa.ListArray.from_arrays(words.first.astype(np.int32), words.hashes.view(np.int64))
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
            yield pa.record_batch([batch.column(0).slice(start, end - start).cast(pa.int64()), tokens, pa.array(hashes, kind)], names=["item_id", "item", "seeds"])


def _hits(bits: int, present: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("hash", pa.int64()), ("at", pa.int32())])
        for batch in batches:
            for start, end in slices(batch.column(1)):
                words = Words(batch.column(1).slice(start, end - start))
                at, names = (np.concatenate(x) for x in zip(*seed_hashes(words)))
                hit = np.arange(len(names))
                for shift in PLACES:
                    place = names[hit] >> np.uint64(shift) & np.uint64((1 << bits) - 1)
                    hit = hit[(present[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1) == 1]
                rows = np.searchsorted(words.first, at[hit], side="right") - 1
                order = np.argsort(rows, kind="stable")
                hit, rows = hit[order], rows[order]
                some = np.unique(rows)
                ends = np.searchsorted(rows, np.append(some, end - start)).astype(np.int32)
                seeds = pa.StructArray.from_arrays([pa.array(names[hit].view(np.int64)), pa.array((at[hit] - words.first[rows]).astype(np.int32))], fields=list(kind))
                tokens = pa.ListArray.from_arrays(words.first.astype(np.int32), words.hashes.view(np.int64)).take(pa.array(some))
                ids = batch.column(0).slice(start, end - start).cast(pa.int64()).take(pa.array(some))
                yield pa.record_batch([ids, tokens, pa.ListArray.from_arrays(ends, seeds)], names=["doc_id", "words", "seeds"])

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            words, item = (batch.column(i)[row].values.to_numpy() for i in (2, 3))
            found = (0, 0, 0, 0)
            for shift in set(batch.column(4)[row].as_py()):
                low, high = max(0, shift), min(len(words), len(item) + shift)
                same = words[low:high] == item[low - shift : high - shift]
                if len(item) > OVERLAP:
                    start, length, equal = longest_overlap(same)
                else:  # whole or not at all, so its first and last word may be changed too
                    start, length, equal = 0, len(same), int(same.sum())
                    if length < len(item) or 100 * equal < EQUAL * length:
                        continue
                found = max(found, (length, equal, -(start + low), -shift))
            length, equal, start, shift = found
            if length >= min(OVERLAP, len(item)) and len(item) >= SHORTEST:
                rows.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), -start, length, equal, len(item)))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "n_words", "n_equal", "item_words"])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, n_equal, item_words: the longest overlap of each document with each item it leaks.

    docs (doc_id, text) and benchmark (item_id, text) are compared by words in
    lower case (A-Z). An overlap is reported if it has ``OVERLAP`` words and begins and ends
    with an equal one, or is the whole of an item of ``SHORTEST`` to ``OVERLAP`` words, and
    ``EQUAL`` percent of it are equal place by place; ``start`` is its first word. Null and empty texts overlap with
    nothing. Repeated rows are reported each; rows without id keep a null id.
    """
    items = cut(benchmark.select("item_id", "text").mapInArrow(_items, "item_id long, item array<long>, seeds array<struct<hash:long,at:int>>").withColumn("entry", F.monotonically_increasing_id()))
    hashes = items.select("entry", F.explode("seeds").alias("seed")).select("entry", "seed.hash", F.col("seed.at").alias("in_item"))
    least, most = FILTER_BITS
    bits = min(max((64 * hashes.count()).bit_length(), least), most)
    places = F.array(*(F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in PLACES))
    octets = hashes.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 3).alias("octet"))
    octets = octets.agg(F.expr("bit_or(shiftleft(1, cast(place & 7 as int)))").alias("bits"))
    present = np.zeros(1 << (bits - 3), np.uint8)
    for octet, value in octets.toLocalIterator():  # at most 2^24 rows, whatever the benchmark
        present[octet] = value
    shared = docs.sparkSession.sparkContext.broadcast(present)

    def hits(batches):
        return _hits(bits, shared.value)(batches)

    found = docs.select("doc_id", "text").mapInArrow(hits, "doc_id long, words array<long>, seeds array<struct<hash:long,at:int>>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    seeds = found.select("row", F.explode("seeds").alias("seed")).select("row", "seed.hash", "seed.at")
    pairs = seeds.join(hashes, "hash").select("row", "entry", (F.col("at") - F.col("in_item")).alias("shift")).distinct()
    pairs = pairs.groupBy("row", "entry").agg(F.collect_list("shift").alias("shifts"))
    laid = pairs.join(found.select("row", "doc_id", "words"), "row")
    laid = salted_lookup(laid, items.select("entry", "item_id", "item"), "entry", F.col("row"))
    return laid.select("doc_id", "item_id", "words", "item", "shifts").mapInArrow(_measure, "doc_id long, item_id long, start long, n_words long, n_equal long, item_words long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, columns unchanged, without the rows whose text overlaps with a benchmark item (see ``contaminations``)."""
    named = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = cut(contaminations(named, benchmark).select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(few(leaks), F.xxhash64("text") == F.col("_leak"), "left_anti")
