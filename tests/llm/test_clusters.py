"""Centroid clustering against plain arithmetic."""

import hashlib
import random

import pytest

from reconcile.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int"


def expected(rows, dims, k, rounds):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and x == x and abs(x) * 256 <= clusters.LARGEST for x in v):
            kept.append((vec_id, [int(256 * x // 1) for x in v]))
    name = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(e for _, e, m in found if m == n), total, sha[n]) for i, d, n in found), key=str)


def found(spark, rows, **options):
    result = clusters.cluster_vectors(spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "own", 1) for i, v in rows], SCHEMA), **options)
    assert all(hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() == r.centroid_sha256 for r in result.collect())
    return sorted(map(tuple, result.drop("centroid").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    nan, inf = float("nan"), float("inf")
    dims = 5
    out = [(None, None), (1, []), (2, [1.0] * 4), (3, [1.0] * 6), (4, [1.0, None, 0, 0, 0]), (5, [nan] * 5), (6, [inf] + [0.0] * 4), (7, [3e38] + [0.0] * 4)]
    centres = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    for n in range(300):
        v = [x + draw.gauss(0, 0.05) for x in draw.choice(centres)]
        out += [(n + 10, v)] * draw.choice([1, 1, 1, 3])  # repeated rows
    out += [(None, [0.5] * 5), (None, [0.25] * 5), (5000, [-500_000.0] * 5), (5001, [500_000.0, 0, 0, 0, 0])]
    # Ties: the same vector as two of the first centroids, and points half-way between them.
    out += [(n, [0.0, 0.0, 0.0, 0.0, float(n % 3)]) for n in range(9000, 9060)]
    return out


@pytest.mark.parametrize("k, rounds", [(7, 0), (7, 3), (40, 2), (1, 5)])
def test_against_plain_arithmetic(spark, rows, k, rounds):
    assert found(spark, rows, dims=5, clusters=k, rounds=rounds) == expected(rows, 5, k, rounds)


def test_chunks_and_wide_blocks_change_nothing(spark, rows, monkeypatch):
    # Many copies make wide blocks; small chunks make many dictionaries.
    copies = rows + [(20_000 + n, rows[n % 4 + 20][1]) for n in range(2000)]
    want = expected(copies, 5, 6, 2)
    assert found(spark, copies, dims=5, clusters=6, rounds=2) == want
    monkeypatch.setattr(clusters, "CHUNK", 16)
    assert found(spark, copies, dims=5, clusters=6, rounds=2) == want


def test_coding_is_lossless():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(1)
    for rows_, high in ((1, 9), (500, 2), (500, 3), (3000, 1000)):
        m = draw.integers(-high, high, (rows_, 8), np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(range(rows_)), pa.array(m.tolist(), pa.list_(pa.int32()))], ["id", "v"])
        (ids, blocks), = clusters._chunks(iter([clusters._chunk([batch], 8)]))
        assert ids.to_pylist() == list(range(rows_)) and (np.hstack([e[c] for e, c in blocks]) == m).all()
        assert all(len(e) <= max(1, rows_ // clusters.SHARE) for e, _ in blocks if e.shape[1] > 1)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, [1.0])]) == []
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.5])]
    assert found(spark, few, dims=2) == expected(few, 2, 40, 5)
