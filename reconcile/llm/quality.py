"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

A document is a vector of transformed statistics. For each language and source the
half of its documents whose covariance has the smallest determinant gives a mean
and a covariance that outliers don't bend, and a document far from the mean, by
Mahalanobis distance under it, is rejected.

The halves are found by concentration steps over all documents at once: distances
under the estimates so far, the nearest half of each group, new estimates from it.
The nearest half is cut at a bin of distance, so a step is one join with the small
table of estimates and one grouping by bin; no group meets in one task. Vectors
are whole multiples of 1/256, so moments are sums of integers and reruns agree.
Three starts that don't hang on chance run side by side; of each group the one that
ends with the smallest determinant counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reconcile.llm.storage import cut, few, salted_lookup
from reconcile.llm.tokens import Words, mix, powers_to, slices

#: Fixed values of the base rules: symbols, words of a window, fewest words, largest share of repeated words in percent.
SYMBOLS, WINDOW, FEWEST_WORDS, MOST_REPEATED = "#*$%&|<>", 5, 10, 20
#: The transformed statistics, in whole steps of 1 / GRID.
NAMES = ("log_words", "word_length", "symbols", "marks", "capitals", "digits", "line_copies", "word_copies")
GRID = 256
#: Share of a group that the estimate rests on, concentration steps, and documents that a group needs.
SHARE, STEPS, LEAST = 0.75, 8, 200
#: Least standard deviation of a statistic (most documents have no symbol at all), and how far a document may be:
#: a multiple of the distance that SHARE of the group's documents stay within.
FLOOR, FAR = 0.25, 6.5
#: Bins of the logarithm of the squared distance.
BINS, PER_E = 1024, 64
STARTS = 3


def document_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, stats of every row.

    Words are runs other than blanks and tab to CR, compared as written; null is
    an empty text, whose counts are 0 and whose statistics are those of no word.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"{id} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<int>"
    return docs.select(F.col(id), F.col(text)).mapInArrow(_counted(id), schema)


_CLASS = {"symbol": np.zeros(256, bool), "mark": np.zeros(256, bool), "digit": np.zeros(256, bool), "upper": np.zeros(256, bool)}
_CLASS["symbol"][[ord(c) for c in SYMBOLS]] = True
_CLASS["mark"][[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS]] = True
_CLASS["digit"][48:58] = True
_CLASS["upper"][65:91] = True


def _counted(id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for start, end in slices(texts):
                ids, part = batch.column(0).slice(start, end - start), texts.slice(start, end - start)
                counts, stats = _statistics(part)
                columns = [ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(stats.tolist(), pa.list_(pa.int32()))]
                names = [id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stats"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _statistics(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    words = Words(texts, lower=False)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return _ranges(flags, offsets[:-1], offsets[1:])

    starts_character = (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    n_words = np.diff(words.first)
    word_chars = per_row(starts_character & ~space)
    symbols, marks, digits, capitals = (per_row(_CLASS[c][data]) for c in ("symbol", "mark", "digit", "upper"))
    lines, dup_lines = _repeated_lines(data, offsets, words)
    repeated = _repeated_words(words)
    some = np.maximum(n_words, 1)
    columns = [
        np.log1p(n_words),
        2 * np.log((word_chars + 1) / some),
        np.log((symbols + 1) / (n_words + 20)),
        np.log((marks + 1) / (n_words + 20)),
        np.log((capitals + 1) / (n_words + 20)),
        np.log((digits + 1) / (n_words + 20)),
        2 * np.arcsin(np.sqrt(dup_lines / np.maximum(lines, 1))),
        2 * np.arcsin(np.sqrt(repeated / some)),
    ]
    stats = np.rint(np.stack(columns, axis=1) * GRID).astype(np.int64)
    return [n_words, word_chars, symbols, dup_lines, repeated], stats


def _ranges(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[end] - sums[begin]


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each row, and those of them that are equal to an earlier one."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # A line begins at a row's start and behind each line feed, and ends before the next of them.
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    row = np.searchsorted(offsets[:-1], begin, "right") - 1
    # A line feed at a row's very end opens an empty line that lies at the next row's start; it holds no word.
    order = np.concatenate((begin[1:], [len(data)]))
    end = np.maximum(np.minimum(order, offsets[row + 1]), begin)
    end = np.where((end > begin) & (data[np.maximum(end, 1) - 1] == 10), end - 1, end) if len(data) else end
    has_word = np.searchsorted(words.begin, end) > np.searchsorted(words.begin, begin)
    begin, end, row = begin[has_word], end[has_word], row[has_word]
    powers, inverse = powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin])
    first = _first_of_equal(row, hashes, end - begin)
    counted = np.bincount(row, minlength=rows)
    return counted, counted - np.bincount(row[first], minlength=rows)


def _first_of_equal(*columns: np.ndarray) -> np.ndarray:
    """Whether each element is the first with its values."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    first = np.zeros(len(order), bool)
    first[order] = new  # lexsort is stable
    return first


def _repeated_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """Words of each row in a window of ``size`` words that the row holds twice or more."""
    rows, total = len(words.first) - 1, len(words.hashes)
    if total < size:
        return np.zeros(rows, np.int64)
    windows = words.ngrams(size)
    row = np.searchsorted(words.first, np.arange(len(windows)), "right") - 1
    inside = np.arange(len(windows)) + size <= words.first[row + 1]
    at, row = np.flatnonzero(inside), row[inside]
    order = np.lexsort((windows[at], row))
    same = (windows[at][order][1:] == windows[at][order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + size, -1)
    return _ranges(np.cumsum(edges)[:-1] > 0, words.first[:-1], words.first[1:])


def base_failed() -> Column:
    n_words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (n_words < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)


def judge_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"), far: float = FAR) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, level, distance, reach of every row.

    ``distance`` is the Mahalanobis distance under the robust estimate of the
    document's group, ``level`` which group that is: its language and source; where these
    have fewer than LEAST documents that pass the base rules, the language's small
    groups together, then all that are left. Where even these are too few nothing is
    judged, and distance is null. A null language or source is one of its own.
    Every row counts by itself, repeated ones and those without id too; an empty
    table gives an empty result; other columns are ignored.
    """
    named = docs.select(
        F.struct(F.col(id).alias("id"), F.col(by[0]).cast("string").alias("lang"), F.col(by[1]).cast("string").alias("source")).alias("row"),
        F.col(text).alias("text"),
    )
    rows = document_statistics(named, "row", "text").withColumn("base_failed", base_failed())
    rows = cut(rows.select("row.*", *[c for c in rows.columns if c != "row"]))
    levelled = _levels(rows)
    good = levelled.where("NOT base_failed AND level IS NOT NULL")
    spread = F.xxhash64("id", "n_words", "word_chars")
    estimates = robust_estimates(good, spread)
    known = estimates.select("g", "mean", "inverse", "reach")
    judged = _met(levelled.withColumn("spread", spread), known, "left")
    distance = F.when(F.col("mean").isNotNull(), F.sqrt(_squared(len(NAMES))))
    fits = F.coalesce(distance <= far * F.col("reach"), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias(id), *counts, "base_failed", (~F.col("base_failed") & fits).alias("kept"), "level", distance.alias("distance"), "reach")


def _levels(rows: DataFrame) -> DataFrame:
    """rows with level (how fine a group judges it, null if none) and g, that group's name."""
    counts = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    counts = counts.withColumn("fine", F.col("n") >= LEAST)
    rest = F.sum(F.when(~F.col("fine"), F.col("n")))
    by_language = counts.groupBy("lang").agg(F.coalesce(rest, F.lit(0)).alias("n_lang"))
    coarse = F.col("n_lang") >= LEAST
    # One number: the documents whose language, too, has too few.
    last = by_language.agg(F.coalesce(F.sum(F.when(~coarse, F.col("n_lang"))), F.lit(0)).alias("n")).first().n
    level = F.when(F.col("fine"), "source").when(coarse, "lang").when(F.lit(last >= LEAST), "all")
    groups = counts.withColumnRenamed("lang", "lang_of").join(by_language, F.col("lang_of").eqNullSafe(F.col("lang"))).withColumn("level", level)
    name = F.when(F.col("level") == "source", F.to_json(F.array("lang", "source"))).when(F.col("level") == "lang", F.to_json(F.array("lang"))).otherwise("all")
    groups = cut(groups.select(F.to_json(F.array("lang", "source")).alias("pair"), "level", name.alias("g")))
    rows = rows.withColumn("_pair", F.to_json(F.array("lang", "source")))
    found = few(groups)
    if found is groups:
        return salted_lookup(rows, groups, "_pair", F.xxhash64("id", "n_words"))
    return rows.join(found, F.col("_pair") == F.col("pair"), "left").drop("_pair", "pair")


def _met(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the estimates of their group g; a hot group is dealt over many tasks if the table is too large to send out."""
    sent = few(estimates)
    if sent is estimates:
        return salted_lookup(rows, estimates, "g", F.col("spread"), how=how)
    return rows.join(sent, "g", how)


def _squared(p: int) -> Column:
    """Squared Mahalanobis distance of the columns stats, mean, inverse (the lower triangle, off-diagonal cells doubled)."""
    d = [F.col("stats")[i] - F.col("mean")[i] for i in range(p)]
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    total = F.lit(0.0)
    for n, (i, j) in enumerate(cells):
        total = total + F.col("inverse")[n] * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _moments(p: int) -> list[Column]:
    one = [F.sum(F.col("stats")[i].cast("long")) for i in range(p)]
    two = [F.sum(F.col("stats")[i].cast("long") * F.col("stats")[j]) for i in range(p) for j in range(i + 1)]
    return [F.count("*").alias("n"), F.array(*one, *two).alias("m")]


def robust_estimates(rows: DataFrame, spread: Column, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """g, n, mean, inverse, reach of each group g of rows (g, stats).

    ``reach`` is the distance within which ``share`` of the group's documents lie.
    """
    p = len(NAMES)
    rows = rows.select("g", "stats", spread.alias("spread"))
    estimates = cut(_first_estimates(rows, p))
    for _ in range(steps):
        estimates = cut(_concentrated(rows, estimates, p, share))
    # The start whose half has the smallest determinant; the first of equal ones.
    best = estimates.groupBy("g").agg(F.min_by(F.struct(F.lit(0).alias("start"), "mean", "inverse"), F.struct("logdet", "start")).alias("e"))
    best = cut(best.select("g", "e.*"))
    reach = _concentrated(rows, best, p, share).select("g", "n", "reach")
    return cut(reach.join(best, "g").select("g", "n", "mean", "inverse", "reach"))


def _first_estimates(rows: DataFrame, p: int) -> DataFrame:
    """g, start, mean, inverse: three estimates that outliers can't bend much, none by chance.

    All have the medians of a statistic as mean. The scatter is 0: the squared median absolute deviations alone; 1: the
    moments of the deviations drawn together by x / (1 + |x|); 2: those of the deviations' directions.
    """
    # Statistics are whole numbers of a small range, so medians come from counts by value.
    long = rows.select("g", F.posexplode("stats").alias("i", "x"))
    medians = _medians(long)
    off = long.join(few(medians), ["g", "i"]).select("g", "i", F.abs(F.col("x") - F.col("median")).alias("x"))
    mads = _medians(off).withColumnRenamed("median", "mad")
    # Never below the floor: most documents may share one value.
    scale = F.greatest(1.4826 * F.col("mad"), F.lit(FLOOR * GRID))
    pairs = medians.join(mads, ["g", "i"]).select("g", F.struct("i", "median", scale.alias("scale")).alias("s"))
    shape = pairs.groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("s"))
    centres = cut(shape.select("g", F.col("s.median").alias("mean"), F.col("s.scale").alias("scale")))
    met = _met(rows, centres)
    z = F.transform(F.arrays_zip("stats", "mean", "scale"), lambda v: (v["stats"] - v["mean"]) / v["scale"])
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    drawn = met.withColumn("z", z).withColumn("norm", norm).select(
        "g", "mean", "scale",
        F.explode(F.array(
            F.struct(F.lit(1).alias("start"), F.transform("z", lambda x: F.rint(GRID * x / (1 + F.abs(x))).cast("int")).alias("stats")),
            F.struct(F.lit(2).alias("start"), F.transform("z", lambda x: F.rint(GRID * x / (F.col("norm") + 1e-9)).cast("int")).alias("stats")),
        )).alias("d"),
    ).select("g", "mean", "scale", "d.*")
    moments = drawn.groupBy("g", "start").agg(*_moments(p)).join(centres, "g")
    plain = centres.select("g", F.lit(0).alias("start"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<bigint>").alias("m"), "mean", "scale")
    both = moments.select("g", "start", "n", "m", "mean", "scale").unionByName(plain)
    return both.mapInArrow(_inverted_starts(p), "g string, start int, mean array<double>, inverse array<double>")


def _medians(values: DataFrame) -> DataFrame:
    """g, i, median: the lower median of x, from counts by value."""
    counts = values.groupBy("g", "i", "x").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("g", "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("g", "i")
    below = counts.withColumn("below", F.sum("n").over(by_value)).withColumn("all", F.sum("n").over(whole))
    return below.where("2 * below >= all").groupBy("g", "i").agg(F.min("x").cast("double").alias("median"))


def _inverted_starts(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                scale = np.array(row["scale"])
                shape = np.eye(p) if row["m"] is None else _scatter(row["n"], row["m"], p)[1] / GRID**2
                # To correlations, so that only the shape of the scatter counts, then to the robust scales.
                spread = np.sqrt(np.maximum(np.diag(shape), 1e-6))
                shape = shape / spread[:, None] / spread
                cov = 0.9 * shape * scale[:, None] * scale + 0.1 * np.diag(scale**2)
                out.append({"g": row["g"], "start": row["start"], "mean": row["mean"], "inverse": _triangle(np.linalg.inv(cov))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("start", pa.int32()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))]))

    return run


def _scatter(n: int, m: list[int], p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from exact sums and sums of products."""
    mean = np.array([int(s) / n for s in m[:p]])
    cov, at = np.zeros((p, p)), p
    for i in range(p):
        for j in range(i + 1):
            # In whole numbers, so that nothing cancels.
            cov[i, j] = cov[j, i] = (n * int(m[at]) - int(m[i]) * int(m[j])) / (n * n)
            at += 1
    return mean, cov


def _triangle(inverse: np.ndarray) -> list[float]:
    p = len(inverse)
    return [float(inverse[i, j]) * (1 if i == j else 2) for i in range(p) for j in range(i + 1)]


def _concentrated(rows: DataFrame, estimates: DataFrame, p: int, share: float) -> DataFrame:
    """One step: g, start, n, reach, logdet, mean, inverse, of the nearest ``share`` under the estimates so far.

    The nearest are all whose squared distance lies up to the bin that fills the share.
    """
    starts = estimates.groupBy("g").agg(F.collect_list(F.struct("start", "mean", "inverse")).alias("e"))
    met = _met(rows, starts).select("g", "stats", F.explode("e").alias("e")).select("g", "stats", "e.*")
    step = F.floor(F.log(_squared(p) + 1e-6) * PER_E) + BINS
    binned = met.withColumn("bin", F.least(F.greatest(step, F.lit(0)), F.lit(3 * BINS)).cast("int"))
    # At most 3 * BINS rows for a group and start.
    moments = binned.groupBy("g", "start", "bin").agg(*_moments(p)).groupBy("g", "start")
    doubles = "mean array<double>, inverse array<double>"
    return moments.applyInArrow(_inverted(p, share), f"g string, start int, n long, reach double, logdet double, {doubles}")


def _inverted(p: int, share: float):
    doubles = pa.list_(pa.float64())
    fields = [("g", pa.string()), ("start", pa.int32()), ("n", pa.int64()), ("reach", pa.float64()), ("logdet", pa.float64()), ("mean", doubles), ("inverse", doubles)]

    def run(table: pa.Table) -> pa.Table:
        bins = sorted(table.to_pylist(), key=lambda row: row["bin"])
        n = sum(row["n"] for row in bins)
        near, sums, last = 0, [0] * (p + p * (p + 1) // 2), 0
        for row in bins:
            if near >= n * share:
                break
            near, last = near + row["n"], row["bin"]
            sums = [a + b for a, b in zip(sums, row["m"])]
        mean, cov = _scatter(near, sums, p)
        cov += np.eye(p) * (FLOOR * GRID) ** 2
        found = {
            "g": bins[0]["g"], "start": bins[0]["start"], "n": n, "reach": float(np.exp((last + 1 - BINS) / PER_E / 2)),
            "logdet": float(np.linalg.slogdet(cov)[1]), "mean": mean.tolist(), "inverse": _triangle(np.linalg.inv(cov)),
        }
        return pa.Table.from_pylist([found], pa.schema(fields))

    return run
