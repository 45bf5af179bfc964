"""Fuzzy line dedup by MinHash, in DataFrame functions.

Equal lines are one. Of each line all character shingles are hashed once; the
least hash after XOR with each of ``BANDS * ROWS`` constants is its signature.
Lines with an equal band of the signature are compared exactly, by the Jaccard
similarity of the shingle sets, unless links connect them already; linked
lines form components, of which one line stays.

Bands of equal members are one group. Its first ``LEADERS`` lines meet all of it; in a larger group
only lines that two links don't bring to where they bring the head then meet the others, part by part. Of lines that
meet, sketches of the shingle sets tell most of those apart that can't be similar; the rest are compared.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reconcile.llm.components import connected_components
from reconcile.llm.storage import cut, few
from reconcile.llm.tokens import mix, powers_to

#: Characters of a shingle, the similarity of a link; BANDS bands of ROWS minima find 0.8 with a chance of 97 % or more (see the README), 0.9 with more than 99.9 %.
SHINGLE, LEAST = 9, 0.8
BANDS, ROWS = 8, 3
#: Lines of a group that meet all of it, lines of a part of a large group, and 64-bit words of a sketch.
LEADERS, PART_LINES, WORDS = 16, 2048, 16
#: Shingles hashed in one row, which spares the aggregation most of its work.
RUN = 8


def shingles_of(lines: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` code points of each line (of the line itself if it has no more), and where each line's begin.

    In numpy, for brute force beside the query, which hashes in Spark.
    """
    joined = "\n".join(lines.to_pylist()) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(chars == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    powers, inverse = powers_to(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[: len(chars)], out=sums[1:])
    counts = np.maximum(ends - starts - size + 1, 1)
    first = np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts) + np.arange(counts.sum())
    until = np.minimum(at + size, np.repeat(ends, counts))
    return mix((sums[until] - sums[at]) * inverse[at]), first


def _last_start(code: Column) -> Column:
    """Where in a UTF-32 text (from byte 1) the last run of SHINGLE code points begins; 1 if it has no more."""
    return F.greatest(F.octet_length(code) - (4 * SHINGLE - 1), F.lit(1))


def _hash_at(code: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(code, start, 4 * SHINGLE))


def _shingles(line: Column) -> Column:
    """The hashes of a line's shingles, as an array; the line is encoded once, not for each of them."""
    codes = F.array(F.encode(line, "utf-32"))
    return F.transform(codes, lambda code: F.transform(F.sequence(F.lit(1), _last_start(code), F.lit(4)), lambda start: _hash_at(code, start)))[0]


def _signatures(lines: DataFrame, seed: int) -> DataFrame:
    """id, b0, b1, ...: the bands of each distinct line."""
    constants = random.Random(seed)
    masks = [F.lit(constants.getrandbits(32)) for _ in range(BANDS * ROWS)]
    codes = lines.select("id", F.encode("line", "utf-32").alias("code")).withColumn("last", _last_start(F.col("code")))
    runs = codes.select("id", "code", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * RUN))).alias("start"))
    # The last run repeats its last shingle. 32 bits of each hash do for minima, and keep the rows of the exchange short.
    starts = (F.least(F.col("start") + 4 * k, F.col("last")) for k in range(RUN))
    hashes = [_hash_at(F.col("code"), start).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"h{k}") for k, start in enumerate(starts)]
    least = (F.least(*(F.col(f"h{k}").bitwiseXOR(mask) for k in range(RUN))) for mask in masks)
    minima = runs.select("id", *hashes).groupBy("id").agg(*(F.min(x).alias(f"m{k}") for k, x in enumerate(least)))
    bands = (F.xxhash64(F.lit(k), *(f"m{row}" for row in range(k * ROWS, (k + 1) * ROWS))).alias(f"b{k}") for k in range(BANDS))
    return minima.select("id", *bands)


def _sketches(texts: DataFrame) -> DataFrame:
    """id, size, w0, w1, ...: how many shingles a line has, and the parity of those that fall on each bit."""
    each = texts.select("id", F.explode(F.array_distinct(_shingles(F.col("line")))).alias("hash"))
    bit = F.expr("shiftleft(1L, cast(shiftright(hash, 4) & 63 as int))")
    word = F.col("hash").bitwiseAND(F.lit(WORDS - 1))
    words = (F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS))
    return each.groupBy("id").agg(F.count("*").alias("size"), *words)


def _may_be_similar(least: float) -> Column:
    """Whether two lines, a and b with their sketches, can be linked.

    A bit differs only for a shingle that one of them has alone, and linked lines have few of those.
    """
    low, high = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    apart = sum((F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(WORDS)), F.lit(0))
    return (low >= least * high - 1e-9) & (apart <= (low + high) * ((1 - least) / (1 + least)) + 1e-6)


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs (a, b, size: that of both) of similar lines, by their whole sets."""
    pairs = cut(pairs.distinct())
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    # Dealt by the later line: a leader meets many.
    both = left.join(few(pairs), "a").repartition("b").join(right, "b")
    shared = F.size(F.array_intersect(_shingles(F.col("line_a")), _shingles(F.col("line_b"))))
    return cut(both.where(shared * (1 + least) >= least * F.col("size") - 1e-9).select("a", "b"))


def _near_roots(links: DataFrame) -> DataFrame:
    """id, root: a line that links connect it to, the least within two links; not yet the least of its component."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).select("id", F.least("id", "root").alias("root"))
    over = ways.join(roots, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("root"))
    return over.withColumnRenamed("a", "id")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of every line that isn't blank."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "").withColumn("id", F.xxhash64("line"))


def line_components(lines: DataFrame, least: float = LEAST, seed: int = 3, part_lines: int = PART_LINES) -> DataFrame:
    """id, component of the distinct lines (id, line) that are similar to another."""
    signed = cut(_signatures(lines, seed))
    bands = signed.select("id", F.explode(F.array(*(f"b{k}" for k in range(BANDS)))).alias("band"))
    # Ids are hashes already.
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("id").alias("members"), F.min("id").alias("head")).where("n > 1")
    groups = cut(groups.groupBy("n", "members", "head").agg(F.min("band").alias("band")).select("band", "n", "head"))
    placed = bands.join(few(groups), "band")
    texts = lines.join(few(placed.select("id").distinct()), "id", "left_semi")
    texts = cut(texts.groupBy("id").agg(F.first("line").alias("line")))
    sketches = cut(_sketches(texts))

    members = placed.select("band", "id").join(sketches, "id")
    rank = F.row_number().over(Window.partitionBy("band").orderBy("id"))
    leaders = placed.select("band", "id").withColumn("rank", rank).where(F.col("rank") <= LEADERS).drop("rank").join(sketches, "id")
    meet = (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id"))
    pair = F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), (F.col("a.size") + F.col("b.size")).alias("size")
    meeting = leaders.alias("a").join(members.alias("b"), meet & _may_be_similar(least))
    links = _compared(meeting.select(*pair), texts, least)

    # Of two lines that aren't known to be connected one at least isn't known to be so to the head: it meets the other parts.
    split = placed.where(F.col("n") > LEADERS).join(_near_roots(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = cut(split.select("band", "id", "n", "head", "root"))
    tops = split.where("id = head").select("band", F.col("root").alias("top"))
    parts = F.ceil(F.col("n") / part_lines).cast("int").alias("parts")
    split = split.join(few(tops), "band").select("band", "id", "root", parts, (F.col("root") != F.col("top")).alias("apart"))
    lone = split.where("apart")
    if not lone.isEmpty():
        rest = split.join(few(lone.select("band").distinct()), "band", "left_semi").withColumn("part", F.expr("cast(pmod(hash(id), parts) as int)"))
        lone = lone.join(sketches, "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        once = ~F.col("b.apart") | (F.col("a.id") < F.col("b.id"))
        meet = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") != F.col("b.root")) & once
        meeting = lone.alias("a").join(rest.join(sketches, "id").alias("b"), meet & _may_be_similar(least))
        links = links.unionByName(_compared(meeting.select(*pair), texts, least))
    return connected_components(links).select(F.col("node").alias("id"), "component")


def repeated_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, line_no, kept_doc_id, kept_line_no: every line of docs (doc_id, text) that goes, and the one that stays for it.

    Lines are parted by line feeds and numbered from 0; blank ones always stay. Equal
    lines, and lines linked by shingle sets of a similarity of ``least`` or more, directly or
    over others, form a component; its first line by (doc_id, line_no) stays. Null
    and empty texts have no lines; rows that repeat a doc_id are one document.
    """
    lines = lines_of(docs)
    classes = line_components(lines, least)
    placed = lines.select("doc_id", "line_no", "id").join(classes, "id", "left")
    placed = cut(placed.select("doc_id", "line_no", F.coalesce("component", "id").alias("class")))
    first = placed.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("kept"), F.count("*").alias("n"))
    first = cut(first.where("n > 1"))  # reread, so that the join can split a hot class
    gone = placed.join(first, "class").where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("kept")))
    return gone.select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the lines of ``gone`` (doc_id, line_no) taken out of their texts."""
    taken = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_of")
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("_of")), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, n: ~F.array_contains("_gone", n))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).drop("_gone", "_of")
