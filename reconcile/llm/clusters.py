"""Centroid clustering over subvector dictionaries.

Vectors are quantised to integers and stored in chunks. A chunk is coded without
loss: its dimensions are cut into blocks, each block has a dictionary of its
distinct subvectors, and a vector is a row of codes. Blocks are as wide as the
chunk's repetition allows: neighbours are joined while the dictionary stays
small beside the chunk. In every round a chunk takes the exact squared distance
of each dictionary entry to each centroid once, and a vector's distances are sums
of those by code. The sums of a cluster come from the dictionaries too: how often
a cluster holds a code, times the code's subvector.

A dictionary travels with its chunk, so none grows with the table; what is sent
out in a round is the centroids. All arithmetic is in integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reconcile.llm.storage import cut

#: Largest quantised component: all squared distances of 64 dimensions fit a long below it.
LARGEST = 1 << 27
#: Vectors of a chunk; rows whose distances are summed at a time; a dictionary may have this share of its chunk's rows.
CHUNK, ROWS, SHARE = 32768, 2048, 4
CODED = "ids array<long>, widths array<int>, entries array<binary>, codes array<binary>"


def cluster_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2"
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every vector kept.

    Kept are vectors of exactly ``dims`` components, none of them null or not
    finite, nor beyond +-2^27 when quantised to floor(scale * x), above which a
    distance is no long. The first centroids are the vectors with the smallest
    sha256 of ``<seed>:<id>`` (ties, as of repeated ids: smaller components
    first); fewer vectors than ``clusters`` give as many centroids. A vector belongs to its nearest centroid, the
    lower number on a tie; after each round a centroid becomes the floor of its
    vectors' mean, an empty one stays. Repeated rows and vectors count each, a
    null id counts as an empty one in the hash, an empty table gives an empty
    result, other columns are ignored.
    """
    def quantised(x: Column) -> Column:
        return F.floor(x.cast("double") * scale)

    usable = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST))
    kept = (
        vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))
        .where(F.coalesce(usable, F.lit(False)))
        .select("id", F.transform("v", lambda x: quantised(x).cast("int")).alias("v"))
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "v").limit(clusters).collect()  # at most ``clusters`` rows
    kind = vectors.schema[id].dataType.simpleString()
    centroids = [list(row.v) for row in first]
    coded = cut(kept.mapInArrow(_encoded(dims), CODED.replace("array<long>", f"array<{kind}>", 1))) if first else None
    for _ in range(rounds if first else 0):
        centroids = _moved(coded, centroids)
    result = f"{id} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not first:
        return vectors.sparkSession.createDataFrame([], result)
    sums = coded.mapInArrow(_distance_sums(centroids), "cluster int, d long").groupBy("cluster").agg(F.sum(F.col("d").cast("decimal(38, 0)")).alias("d"))
    inertias = {row.cluster: int(row.d) for row in sums.collect()}  # one row for each cluster
    return coded.mapInArrow(_labelled(centroids, inertias, id), result)


def _encoded(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                yield _chunk(held, dims)
                held, rows = [], 0
        if rows:
            yield _chunk(held, dims)

    return run


def _chunk(batches: list[pa.RecordBatch], dims: int) -> pa.RecordBatch:
    """One row: the ids, and of each block its width, its distinct subvectors and the vectors' codes."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, lists = table.column(0).combine_chunks(), table.column(1).combine_chunks()
    matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    blocks = [_coded(matrix[:, [d]]) for d in range(dims)]
    most = len(matrix) // SHARE
    while True:
        joined = []
        for left, right in zip(blocks[::2], blocks[1::2]):
            both = _joined(left, right, most)
            joined += [both] if both else [left, right]
        joined += blocks[len(blocks) // 2 * 2 :]
        if len(joined) == len(blocks):
            break
        blocks = joined
    widths = [entries.shape[1] for entries, _ in blocks]
    columns = [widths, [e.astype(np.int32).tobytes() for e, _ in blocks], [_narrow(c).tobytes() for _, c in blocks]]
    kinds = [pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
    offsets = pa.array([0, len(ids)], pa.int32())
    arrays = [pa.ListArray.from_arrays(offsets, ids), *[pa.array([c], k) for c, k in zip(columns, kinds)]]
    return pa.RecordBatch.from_arrays(arrays, ["ids", "widths", "entries", "codes"])


def _coded(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entries, codes = np.unique(column[:, 0], return_inverse=True)
    return entries[:, None], codes


def _joined(left: tuple, right: tuple, most: int) -> tuple | None:
    """Two blocks as one, unless its dictionary would be larger than ``most``."""
    pairs, codes = np.unique(left[1] * len(right[0]) + right[1], return_inverse=True)
    if len(pairs) > most:
        return None
    a, b = np.divmod(pairs, len(right[0]))
    return np.hstack([left[0][a], right[0][b]]), codes


def _narrow(codes: np.ndarray) -> np.ndarray:
    return codes.astype(_code_type(int(codes.max()) + 1))


def _code_type(entries: int) -> type:
    return np.uint8 if entries <= 1 << 8 else np.uint16 if entries <= 1 << 16 else np.uint32


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    """ids and blocks (entries, codes) of each chunk."""
    for batch in batches:
        for row in range(len(batch)):
            blocks = []
            widths, entries, codes = (batch.column(c)[row].as_py() for c in (1, 2, 3))
            for width, entry, code in zip(widths, entries, codes):
                values = np.frombuffer(entry, np.int32).reshape(-1, width).astype(np.int64)
                blocks.append((values, np.frombuffer(code, _code_type(len(values)))))
            yield batch.column(0)[row].values, blocks


def _nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid."""
    tables, at = [], 0
    for entries, _ in blocks:
        part = centroids[:, at : at + entries.shape[1]]
        at += entries.shape[1]
        table = np.zeros((len(entries), len(centroids)), np.int64)
        for d in range(entries.shape[1]):
            table += (entries[:, [d]] - part[:, d]) ** 2
        tables.append(table)
    rows = len(blocks[0][1])
    labels, distances = np.empty(rows, np.int64), np.empty(rows, np.int64)
    for start in range(0, rows, ROWS):
        total = tables[0][blocks[0][1][start : start + ROWS]]
        for table, (_, codes) in zip(tables[1:], blocks[1:]):
            total += table[codes[start : start + ROWS]]
        best = total.argmin(axis=1)  # the first of equal ones
        labels[start : start + ROWS] = best
        distances[start : start + ROWS] = total[np.arange(len(best)), best]
    return labels, distances


def _moved(coded: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; what the driver gets is a sum for each cluster and dimension."""
    given = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _chunks(batches):
            labels, _ = _nearest(blocks, given)
            sums = []
            for entries, codes in blocks:
                held = np.bincount(labels * len(entries) + codes, minlength=len(given) * len(entries))
                sums.append(held.reshape(len(given), -1) @ entries)
            counts = np.bincount(labels, minlength=len(given))
            cells = np.hstack([counts[:, None], *sums])
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells[used].tolist(), pa.list_(pa.int64()))], ["cluster", "cells"])

    parts = coded.mapInArrow(run, "cluster int, cells array<long>")
    sums = parts.select("cluster", F.posexplode("cells")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38, 0)")).alias("total"))
    found: dict[int, dict[int, int]] = {}
    for row in sums.collect():  # clusters times dimensions
        found.setdefault(row.cluster, {})[row.pos] = int(row.total)
    return [
        [found[c][d + 1] // found[c][0] for d in range(len(old))] if c in found else old
        for c, old in enumerate(centroids)
    ]


def _distance_sums(centroids: list[list[int]]):
    given = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _chunks(batches):
            labels, distances = _nearest(blocks, given)
            used = np.unique(labels)
            totals = [int(distances[labels == c].sum()) for c in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals, pa.int64())], ["cluster", "d"])

    return run


def _labelled(centroids: list[list[int]], inertias: dict[int, int], id: str):
    given = np.array(centroids, np.int64)
    own = [inertias.get(c, 0) for c in range(len(given))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _chunks(batches):
            labels, distances = _nearest(blocks, given)
            which = pa.array(labels, pa.int32())
            columns = [
                ids,
                which,
                pa.array(distances, pa.int64()),
                pa.array(own, pa.int64()).take(which),
                pa.array([total] * len(labels), pa.int64()),
                pa.array(names, pa.string()).take(which),
                pa.array(centroids, pa.list_(pa.int64())).take(which),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"])

    return run
