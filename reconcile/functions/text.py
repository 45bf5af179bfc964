"""Text: normalisation, line diffs and line change counts of two versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reconcile.functions.linediff import unified

# The characters of the Unicode property White_Space, newline apart.
WHITE_SPACE = "\t\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalize(text: Column) -> Column:
    """Drop white space at the end of every line and of the whole text.

    ``\\r\\n`` becomes ``\\n``. Indentation, inner blank lines, case and comments
    stay. Trimming line by line takes a fraction of the time of a regular
    expression over the text.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.rtrim(line, F.lit(WHITE_SPACE)))
    return F.rtrim(F.array_join(lines, "\n"), F.lit(WHITE_SPACE + "\n"))


def line_diff(key: Column, old: Column, new: Column, context: int = 3) -> Column:
    """Unified line diff of two texts, null where either is null.

    Two header lines, then the changed lines with ``context`` unchanged lines
    around them, marked ``-``, ``+`` and blank; no position lines. Spark runs a
    Python function on every row whatever CASE surrounds it, so give it null
    texts for rows without a change: these cost nothing.
    """

    @F.arrow_udf("string")
    def diff(keys: pa.Array, olds: pa.Array, news: pa.Array) -> pa.Array:
        return diff_batch(keys, olds, news, context)

    return diff(key, old, new)


def diff_batch(keys: pa.Array, olds: pa.Array, news: pa.Array, context: int) -> pa.Array:
    """The diffs of a batch; Python strings and lines exist for a few rows of it at a time."""
    parts = [pa.array([], pa.string())]
    for start in range(0, len(keys), 64):
        rows = zip(*(side.slice(start, 64).to_pylist() for side in (keys, olds, news)))
        diffs = [None if o is None or n is None else unified(k, o, n, context) for k, o, n in rows]
        parts.append(pa.array(diffs, pa.string()))
    return pa.concat_arrays(parts)


def line_changes(old: Column, new: Column) -> Column:
    """``struct<lines_added, lines_removed>``: how often lines occur more often on one side.

    Works inside the row: the lines of both texts are sorted together, and one
    pass over them adds up each run of equal lines. Nothing is shuffled, and a
    key with very many lines is no heavier than its own text.
    """
    tagged = F.array_sort(
        F.concat(
            F.transform(F.split(old, "\n", -1), lambda l: F.struct(l.alias("line"), F.lit(-1).alias("n"))),
            F.transform(F.split(new, "\n", -1), lambda l: F.struct(l.alias("line"), F.lit(1).alias("n"))),
        )
    )
    zero = F.lit(0).cast("bigint")

    def state(line, n, added, removed):
        return F.struct(line.alias("line"), n.alias("n"), added.alias("added"), removed.alias("removed"))

    def close(s):
        return s["added"] + F.greatest(s["n"], zero), s["removed"] + F.greatest(-s["n"], zero)

    def step(s, x):
        same = state(s["line"], s["n"] + x["n"], s["added"], s["removed"])
        other = state(x["line"], x["n"].cast("bigint"), *close(s))
        return F.when(s["line"].eqNullSafe(x["line"]), same).otherwise(other)

    def finish(s):
        added, removed = close(s)
        return F.struct(added.alias("lines_added"), removed.alias("lines_removed"))

    start = state(F.lit(None).cast("string"), zero, zero, zero)
    return F.when(old.isNotNull() & new.isNotNull(), F.aggregate(tagged, start, step, finish))


def line_change_counts(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """``keys, lines_added, lines_removed`` of every row."""
    counted = pairs.select(*keys, line_changes(F.col(old), F.col(new)).alias("__counts"))
    return counted.select(*keys, "__counts.lines_added", "__counts.lines_removed")
