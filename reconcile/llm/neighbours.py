"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector of unit length falls, in each of ``tables`` tables, into the bucket
``floor((a_i x + b_i) / width)`` for i below ``hashes``. A query visits its own bucket and
``probes - 1`` buckets around it, those first into which a near vector most
likely fell: by the summed squared distances of the query to the bucket borders it
crosses. Every table's finds are reranked by exact cosine and merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

NEAREST = 5
TABLES, HASHES, WIDTH, PROBES, SEED = 8, 6, 2.0, 40, 11
#: Vectors of a bucket that one task looks at together; larger buckets are dealt over several.
CHUNK = 4096


@cache
def _projections(length: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng([seed, length])
    lines, shifts = random.standard_normal((length, tables * hashes)), random.uniform(0, width, tables * hashes)
    return lines, shifts, random.integers(1, 1 << 62, (tables, hashes)) | 1


def perturbations(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """The first ``probes`` moves of a bucket (an array of -1, 0, 1), likeliest first.

    ``inside`` says where between the borders 0 and 1 the query lies in each
    hash. A move costs the summed squares of the way to the borders it crosses;
    cheapest sets are made from cheaper ones by shifting their last border to
    the next or adding that.
    """
    hashes = len(inside)
    borders = sorted([(x * x, i, -1) for i, x in enumerate(inside)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(inside)])
    moves = [np.zeros(hashes, np.int64)]
    heap = [(borders[0][0], (0,))]
    while heap and len(moves) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({borders[m][1] for m in chosen}) == len(chosen):  # not both borders of one hash
            move = np.zeros(hashes, np.int64)
            for m in chosen:
                move[borders[m][1]] = borders[m][2]
            moves.append(move)
        last = chosen[-1]
        if last + 1 < len(borders):
            heapq.heappush(heap, (cost - borders[last][0] + borders[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + borders[last + 1][0], (*chosen, last + 1)))
    return moves


def _buckets(tables: int, hashes: int, width: float, probes: int, seed: int) -> Column:
    """Bucket names of each vector: its own in every table, or all that a query probes."""

    @F.pandas_udf("array<long>")
    def names(vectors: pd.Series) -> pd.Series:
        out = []
        for vector in vectors:
            lines, shifts, factors = _projections(len(vector), tables, hashes, width, seed)
            x = np.asarray(vector, np.float64)
            x = x / np.abs(x).max()
            at = ((x / np.sqrt((x * x).sum())) @ lines + shifts) / width
            bucket = np.floor(at).astype(np.int64).reshape(tables, hashes)
            inside = (at - np.floor(at)).reshape(tables, hashes)
            found = []
            for t in range(tables):
                moves = perturbations(inside[t], probes) if probes > 1 else [0]
                # The table and the length are in the name: only vectors of one length meet.
                found += [((bucket[t] + move) * factors[t]).sum() + t * 0x1F123BB5 + len(vector) * 0x51ED270B1 for move in moves]
            out.append(np.asarray(found, np.int64))
        return pd.Series(out)

    return names


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the same order whatever the rows' places: equal vectors score equal."""
    return (a * b).sum(axis=-1)


def best(query: np.ndarray, query_norm: float, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, own: int, nearest: int):
    """(vec_id, cosine) of the nearest few, other than the query's own, ties to the smaller id."""
    rough = vectors @ query / (norms * query_norm)
    rough[ids == own] = -2
    few = min(nearest, len(ids))
    least = np.partition(rough, len(ids) - few)[len(ids) - few] - 1e-9
    near = np.flatnonzero((rough >= least) & (ids != own))
    exact = _dots(vectors[near], query) / (norms[near] * query_norm)
    order = np.lexsort((ids[near], -exact))[:nearest]
    return ids[near][order], exact[order]


def _search(nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket and chunk, the chunk's vectors first, then the queries that probe it.
        group, waiting, block = None, [], None
        for batch in batches:
            queries, near, scores = [], [], []
            buckets, chunks, kinds, ids = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for row in range(len(ids)):
                key = (buckets[row], chunks[row])
                if key != group:
                    group, waiting, block = key, [], None
                vector = flat[offsets[row] : offsets[row + 1]]
                if not kinds[row]:
                    waiting.append((ids[row], vector))
                elif waiting:
                    if block is None:
                        vectors = np.stack([v for _, v in waiting])
                        block = np.asarray([i for i, _ in waiting]), vectors, np.sqrt(_dots(vectors, vectors))
                    found, cosines = best(vector, float(np.sqrt(_dots(vector, vector))), *block, ids[row], nearest)
                    queries += [ids[row]] * len(found)
                    near.append(found)
                    scores.append(cosines)
            columns = [np.asarray(queries, np.int64), *(np.concatenate([np.zeros(0, t), *c]) for t, c in ((np.int64, near), (np.float64, scores)))]
            yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, tables: int = TABLES, hashes: int = HASHES,
    width: float = WIDTH, probes: int = PROBES, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query among all other rows of (vec_id, embedding).

    Nearness is the cosine of the original vectors in double precision, ties to
    the smaller id. Vectors that are null, empty or zero, or hold a null or
    non-finite component, and rows without id take no part; vectors of different
    length never meet. Of equal vectors only the few with the smallest ids can be
    among the nearest, so only those are indexed. A query that finds nothing has no
    row; repeated rows of one id and vector count once.
    """
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("vector"), is_query.alias("asks"))
    usable = usable.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(finite & F.exists("vector", lambda x: x != 0))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    points = usable.select("vec_id", "vector").distinct().withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= nearest + 1)
    own = _buckets(tables, hashes, width, 1, seed)
    probed = _buckets(tables, hashes, width, probes, seed)
    index = points.select("vec_id", "vector", F.explode(own("vector")).alias("bucket"))
    queries = usable.where("asks").select("vec_id", "vector").distinct().select("vec_id", "vector", F.explode(probed("vector")).alias("bucket"))
    # Buckets above CHUNK vectors are dealt over several groups, and each probe goes to all of them.
    sizes = index.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = index.hint("merge").join(sizes, "bucket").withColumn("chunk", F.expr("cast(pmod(xxhash64(vec_id), chunks) as int)"))
    # Never a broadcast of the probes: as one vector stands in many rows they look small when compressed.
    asked = queries.hint("merge").join(sizes, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    both = dealt.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    both = both.select("bucket", "chunk", "kind", "vec_id", "vector").repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "kind")
    found = both.mapInArrow(_search(nearest), "query_id long, vec_id long, score double").distinct()
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
