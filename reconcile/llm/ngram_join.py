"""N-gram Jaccard join on a distributed R-tree of count vectors.

The words of each document are hashed into shingles, and equal sets of shingles
become one point. A set's shingles are counted in hash groups; the overlap of two
sets is at most the sum, over the groups, of the smaller count. The points are
held in R-trees: pages of points with the largest count of each group. A page, and
then a pair, is dropped where summed coordinate minima stay below the overlap that
a link needs; what survives is verified on the shingles themselves.

A single tree over everything can't do it: unrelated documents have nearly
equal hashed counts, so boxes of unrelated points overlap everywhere and the work
is quadratic. The root is therefore a table of exact cells. Two sets that link
differ in at most D shingles, where D follows from the size; cut into more than D
groups by hash, at least one group is equal in both. The sets of an equal group are
a cell with a tree of its own; nothing is connected before the vectors allow it, since
passages that unrelated documents share would chain most of a corpus. Only what the trees
of the vectors leave connected is verified, and only then are shingles moved. No link is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reconcile.llm.components import connected_components
from reconcile.llm.storage import cut, few
from reconcile.llm.tokens import Words, mix, sequence_hash, slices

#: Percent of the union that two linked sets share, and words of a shingle.
LEAST, WORDS = 85, 4
#: Least and most groups of a count vector (powers of two), shingles that a group has on average within these.
GROUPS, MOST_GROUPS, MEAN = 128, 4096, 4
#: Points of a page, shingles of a part of a large cell, shingles a cell's group should have.
PAGE, PART, SOLID = 32, 1_000_000, 3
#: Largest count that a vector holds (it stands for any larger one), and points of a part of a large cell.
FULL, POINTS = 255, 4096
#: Ratio of the largest to the smallest size of a class.
RATIO = 1.4
#: Sets a task remembers in order to send the groups of copies only once.
REMEMBERED = 200_000
_SALT = np.uint64(0x5851F42D4C957F2D)


def _tops(least: int) -> list[int]:
    """Largest size of each class; sets of the first class link with equal sets only, as n / (n + 1) is too little."""
    tops = [-(-least // (100 - least)) - 1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * RATIO)))
    return tops


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; all words as one if there are fewer; none without words."""
    grams = words.ngrams(size) if len(words.hashes) >= size else None
    for start, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - start >= size:
            yield np.unique(grams[start : end - size + 1])
        elif end > start:
            yield sequence_hash([words.hashes[i : i + 1] for i in range(start, end)])
        else:
            yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.asarray([np.add.reduce(mix(shingles + _SALT)) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def lone_name(doc_id: int | None) -> int:
    """A name for the document itself."""
    return int(mix(np.asarray([-1 if doc_id is None else doc_id], np.int64).view(np.uint64) * np.uint64(3) + _SALT).view(np.int64)[0])


def cell_keys(shingles: np.ndarray, tops: list[int], least: int) -> np.ndarray:
    """Keys of which two linked, different sets share at least one.

    For the class of the size (and the one below, if a set of that class can
    link) the shingles are cut by hash into more groups than the D shingles in which
    two linked sets of the class can differ. If more than D groups are SOLID, they
    are enough; else all that aren't empty are taken, and if those are too few a
    further cut is added. Both rules only look at one set, and a group that
    is equal in both sets is taken by both or by neither: at the first cut
    where one of two linked sets has enough groups they share a key.
    """
    n = len(shingles)
    top = bisect_left(tops, n)
    keys = []
    for c in (top, top - 1):
        if c < 1 or c < top and 100 * tops[c] < least * n:
            continue
        differ = (100 - least) * tops[c] // least
        groups = -(-5 * (differ + 1) // 4)
        edges = (np.arange(groups + 1, dtype=np.float64) * (2.0**64 / groups))[1:-1].astype(np.uint64)
        for again in range(64):
            own = shingles if not again else np.sort(mix(shingles + np.uint64(again)))
            bounds = np.concatenate(([0], np.searchsorted(own, edges), [n]))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own + _SALT))))
            sizes = np.diff(bounds)
            names = mix((sums[bounds[1:]] - sums[bounds[:-1]]) + mix(np.arange(groups, dtype=np.uint64) + np.uint64((c * 64 + again) << 32)))
            solid = sizes >= SOLID
            if solid.sum() > differ:
                keys.append(names[solid])
                break
            keys.append(names[sizes > 0])
            if (sizes > 0).sum() > differ:
                break
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall in each group, up to FULL; larger sets have more groups, as few full ones tell nothing apart."""
    groups = min(max(1 << (len(shingles) // MEAN).bit_length() - 1 if len(shingles) >= MEAN else 1, GROUPS), MOST_GROUPS)
    return np.minimum(np.bincount(shingles & np.uint64(groups - 1), minlength=groups), FULL).astype(np.uint8)


def folded(vectors: list[np.ndarray], groups: int) -> np.ndarray:
    """The vectors in so few groups, a row each: groups that agree in their low bits are one."""
    rows = [v if len(v) == groups else np.minimum(v.reshape(-1, groups).sum(axis=0, dtype=np.int64), FULL) for v in vectors]
    return np.stack(rows).astype(np.uint8)


def _marks(words: int, least: int):
    tops = _tops(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).cast(pa.int64())
            for start, end in slices(texts):
                keys, owners, names, sizes, vectors = [], [], [], [], []
                for row, shingles in enumerate(shingle_sets(Words(texts.slice(start, end - start)), words), start):
                    # A text without words links with nothing: it is a point of its own, named after its id.
                    name = digest(shingles) if len(shingles) else lone_name(ids[row].as_py())
                    names.append(name)
                    sizes.append(len(shingles))
                    vectors.append(count_vector(shingles).tobytes())
                    if len(shingles) and name not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(name)
                        keys.append(cell_keys(shingles, tops, least))
                        owners.append(np.full(len(keys[-1]), name, np.int64))
                key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                owner = np.concatenate(owners) if owners else key
                # Within the slice, sets of one key hang under the first; only that one goes on to meet other slices.
                order = np.argsort(key, kind="stable")
                key, owner = key[order], owner[order]
                heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
                head_of = np.repeat(heads, np.diff(np.append(heads, len(key))))
                under = owner[head_of]
                lone = head_of == np.arange(len(key))
                key = np.where(lone, key, key ^ owner)  # so that a hot key is dealt out; its set gives it back
                rows = end - start
                names = np.asarray(names, np.int64)
                yield pa.record_batch([
                    pa.array(np.concatenate((mix(names.view(np.uint64) + np.arange(start, end, dtype=np.uint64)).view(np.int64), key))),
                    pa.array(np.concatenate((names, owner))),
                    pa.concat_arrays([ids.slice(start, rows), pa.array(under, mask=lone)]),
                    pa.array(np.concatenate((np.asarray(sizes, np.int32), np.full(len(key), -1, np.int32)))),
                    pa.array([*vectors, *[None] * len(key)], pa.binary()),
                ], names=["key", "set", "other", "n", "counts"])

    return run


class _Tree:
    """Pages of count vectors in order of size, each with its largest counts and its range of sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.order = np.argsort(sizes, kind="stable")
        self.counts = vectors[self.order]
        self.starts = np.arange(0, len(sizes), PAGE)
        self.ends = np.minimum(self.starts + PAGE, len(sizes))
        self.boxes = np.maximum.reduceat(self.counts, self.starts)
        self.least, self.most = sizes[self.order[self.starts]], sizes[self.order[self.ends - 1]]


def _trees(parts: list[list[tuple[np.ndarray, int]]]) -> list[_Tree]:
    """A tree of the (vector, size) of each part, all in the groups of the shortest vector."""
    groups = min(len(v) for part in parts for v, _ in part)
    return [_Tree(folded([v for v, _ in part], groups), np.asarray([n for _, n in part])) for part in parts]


def tree_join(left: _Tree, right: _Tree, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i of left, js of right) whose summed coordinate minima allow a link; each pair once if the trees are one."""
    same = left is right
    for p in range(len(left.starts)):
        need = least * (left.least[p] + right.least) / (100 + least)
        fits = (100 * right.most >= least * left.least[p]) & (100 * left.most[p] >= least * right.least)
        fits &= (np.arange(len(fits)) >= p) | (not same)
        pages = np.flatnonzero(fits)
        bound = np.minimum(left.boxes[p], right.boxes[pages]).sum(axis=1, dtype=np.int64)
        pages = pages[(bound >= need[pages] - 1e-6) | (right.boxes[pages].max(axis=1) == FULL)]
        if not len(pages):
            continue
        rows = np.concatenate([np.arange(right.starts[q], right.ends[q]) for q in pages])
        theirs, their_sizes = right.counts[rows], right.sizes[right.order[rows]]
        for at in range(left.starts[p], left.ends[p]):
            i = left.order[at]
            size = left.sizes[i]
            near = np.flatnonzero((100 * np.minimum(size, their_sizes) >= least * np.maximum(size, their_sizes)) & ((rows > at) | (not same)))
            bound = np.minimum(left.counts[at], theirs[near]).sum(axis=1, dtype=np.int64)
            near = near[((100 + least) * bound >= least * (size + their_sizes[near])) | (left.counts[at].max() == FULL)]
            if len(near):
                yield i, right.order[rows[near]]


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): set i of left links with sets js of right; within left, each pair once, if right is None."""
    other = left if right is None else right
    flat = np.concatenate([*left, *(right or [])])
    _, dense = np.unique(flat, return_inverse=True)
    ends = np.cumsum([0, *map(len, left), *map(len, right or [])])
    shift = 0 if right is None else len(left)
    mark = np.zeros(dense.max(initial=0) + 1, np.int64)
    trees = _trees([[(count_vector(x), len(x)) for x in part] for part in (left, right) if part is not None])
    for i, js in tree_join(trees[0], trees[-1], least):
        mine = dense[ends[i] : ends[i + 1]]
        mark[mine] = 1
        starts, lengths = ends[js + shift], np.asarray([len(other[j]) for j in js])
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        picked = np.repeat(starts - at, lengths) + np.arange(lengths.sum())
        shared = np.add.reduceat(mark[dense[picked]], at)
        mark[mine] = 0
        js = js[100 * shared >= least * (len(left[i]) + lengths - shared)]
        if len(js):
            yield i, js


def _grouped(batches: Iterator[pa.RecordBatch], value) -> Iterator[tuple[int, int, dict]]:
    """(low, high, rows by set) of each cell's two parts, from rows sorted by cell, low, high; rows are (part, set, copies, value)."""
    group, held = None, {}
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for row, (cell, low, high, part, name, copies) in enumerate(zip(*columns)):
            if (cell, low, high) != group:
                if group and len(held) > 1:
                    yield *group[1:], held
                group, held = (cell, low, high), {}
            held.setdefault(name, (part, name, copies, value(batch, row)))
    if group and len(held) > 1:
        yield *group[1:], held


def _links(groups: Iterator[tuple[int, int, dict]], pairs_of) -> Iterator[pa.RecordBatch]:
    """a, the set b it hangs under, and the documents it links to, by the pairs that ``pairs_of`` finds in or between two parts."""
    for low, high, held in groups:
        rows = list(held.values())
        first = [i for i, r in enumerate(rows) if r[0] == rows[0][0]]
        rest = [i for i, r in enumerate(rows) if r[0] != rows[0][0]]
        if low != high and not rest:
            continue
        names, copies = (np.asarray([r[k] for r in rows], np.int64) for k in (1, 2))
        parents, counts = list(range(len(rows))), np.zeros(len(rows), np.int64)

        def root(i: int) -> int:
            while parents[i] != i:
                parents[i] = parents[parents[i]]
                i = parents[i]
            return i

        mine, theirs = np.asarray(first), np.asarray(rest or first)
        for i, js in pairs_of([rows[i][3] for i in first], [rows[i][3] for i in rest] if rest else None):
            i, js = mine[i], theirs[js]
            counts[i] += copies[js].sum()
            counts[js] += copies[i]
            for j in js.tolist():
                a, b = root(int(i)), root(j)
                parents[max(a, b)] = min(a, b)
        some = np.flatnonzero(counts)
        roots = np.asarray([root(int(i)) for i in some], np.int64)
        yield pa.record_batch([pa.array(names[some]), pa.array(names[roots]), pa.array(counts[some])], names=["a", "b", "links"])


def _verify(least: int):
    """Links of the sets of each cell, by their shingles."""

    def run(batches):
        groups = _grouped(batches, lambda batch, row: batch.column(6)[row].values.to_numpy().view(np.uint64))
        yield from _links(groups, lambda left, right: _linked(left, right, least))

    return run


def _near(least: int):
    """Links that the count vectors of each cell leave possible."""

    def pairs(left, right):
        trees = _trees([left] if right is None else [left, right])
        return tree_join(trees[0], trees[-1], least)

    def run(batches):
        yield from _links(_grouped(batches, lambda batch, row: (np.frombuffer(batch.column(6)[row].as_py(), np.uint8), batch.column(7)[row].as_py())), pairs)

    return run


def _by_cell(rows: DataFrame, *values: str) -> DataFrame:
    """rows (set, cell, parts, ...) so that every two of a cell's parts come together, sorted, in a partition."""
    rows = rows.withColumn("part", F.expr("cast(pmod(hash(set), parts) as int)"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cell", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "set", "copies", *values)
    return rows.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")


def _by_key(edges: DataFrame) -> DataFrame:
    """set, cell: the sets of each key of edges (a, b, key); keys of the same sets are one cell."""
    members = cut(edges.select("key", F.explode(F.array("a", "b")).alias("set")).distinct())
    digests = F.bit_xor(F.xxhash64("set")), F.bit_xor(F.xxhash64("set", F.lit(1)))
    keys = members.groupBy("key").agg(F.count("*").alias("m"), *(x.alias(f"x{i}") for i, x in enumerate(digests)))
    keys = keys.groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    return members.join(keys, "key", "left_semi").select("set", F.col("key").alias("cell"))


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0), batch.column(1).to_pylist()
            for start, end in slices(texts):
                rows, arrays = [], []
                for row, shingles in enumerate(shingle_sets(Words(texts.slice(start, end - start)), words), start):
                    if len(shingles) and digest(shingles) == wanted[row]:
                        rows.append(row)
                        arrays.append(shingles)
                flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), flat)
                kept = batch.slice(start, end - start).take(pa.array([r - start for r in rows], pa.int64()))
                yield pa.record_batch([*(kept.column(i) for i in range(1, 5)), lists], names=["set", "cell", "copies", "parts", "shingles"])

    return run


def ngram_join(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of docs (doc_id, text).

    Two documents link when ``100 * intersection >= least * union`` of their sets
    of ``words``-word shingles (A-Z in lower case). ``component_id`` is the least
    doc_id that links lead to, its own included; ``n_links`` counts the linked
    documents, copies included. A text with fewer words is one shingle; a null
    text or one without words has none and links with nothing. Repeated rows are
    copies of each other and both returned; a row without doc_id links like any
    other, and its component is null only if no member has an id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = rows.mapInArrow(_marks(words, least), "key long, set long, other long, n int, counts binary")
    # All sets of a key hang under its least one.
    in_key = Window.partitionBy("key").orderBy("set").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = F.when(F.col("n") < 0, F.coalesce("other", F.min("set").over(in_key)))
    found = marks.withColumn("under", under).where("n >= 0 OR set <> under")
    doc_id, true_key = F.when(F.col("n") >= 0, F.col("other")), F.when(F.col("other").isNull(), F.col("key")).otherwise(F.expr("key ^ set"))
    found = cut(found.select("set", "under", "n", doc_id.alias("doc_id"), F.when(F.col("n") < 0, true_key).alias("key"), "counts"))

    members = found.where("n >= 0").groupBy("doc_id", "set", "n").agg(F.count("*").alias("times"))
    sets = members.groupBy("set").agg(F.min("doc_id").alias("first"), F.sum("times").alias("copies"), F.max("n").alias("n"))
    edges = found.where("n < 0").select(F.col("set").alias("a"), F.col("under").alias("b"), "key")
    sets = cut(sets)
    # First the trees of each key, then, for what they leave connected, with the shingles.
    points = cut(sets.join(_by_key(edges), "set").select("set", "cell", "copies", "n"))
    points = points.join(points.groupBy("cell").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("parts")), "cell")
    vectors = found.where("n > 0").join(points.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.first("counts").alias("counts"))
    near = cut(_by_cell(points.join(vectors, "set"), "counts", "n").mapInArrow(_near(least), "a long, b long, links long"))

    cells = connected_components(near.select("a", "b")).select(F.col("node").alias("set"), F.col("component").alias("cell"))
    points = cut(sets.join(cells, "set").select("set", "cell", "first", "copies", "n"))
    points = points.join(points.groupBy("cell").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts")), "cell")
    texts = rows.join(few(points), F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "set", "cell", "copies", "parts")
    trees = texts.mapInArrow(_shingles(words), "set long, cell long, copies long, parts int, shingles array<long>")
    links = cut(_by_cell(trees, "shingles").mapInArrow(_verify(least), "a long, b long, links long"))

    linked = connected_components(links.select("a", "b")).select(F.col("node").alias("set"), F.col("component").alias("root"))
    n_links = links.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    placed = sets.join(linked, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least_id = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(least_id, "root").join(n_links, "set", "left")
    others = F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    placed = placed.select("set", "component_id", others.alias("n_links"))
    every = members.join(placed, "set").withColumn("_", F.explode(F.expr("array_repeat(0, cast(times as int))")))
    return every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("n_links").cast("long"))


def without_near_duplicates(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """docs, columns unchanged, with one document of each component: that with the least doc_id.

    Rows without doc_id stay, as nothing could name them. Of rows that agree in
    doc_id and text one stays; rows that only share a doc_id go together, and only
    if each of them has a component with a smaller id.
    """
    found = cut(ngram_join(docs, least, words).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("component_id").alias("component_id"), F.count("*").alias("times")
    ))
    gone = found.where("component_id < doc_id").select("doc_id")
    kept = docs.join(few(gone), "doc_id", "left_anti")
    again = found.where("times > 1 AND component_id = doc_id").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(few(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(few(again), "doc_id", "left_anti").unionByName(once)
