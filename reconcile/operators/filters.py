"""Scope: ``database.table`` patterns with ``*`` as predicates and as a semi join."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reconcile.functions.automaton import PatternAutomaton

NOT_NEWLINE = r"[^\n]*"  # what a * inside a longer pattern stands for


def resolve_targets(targets: Sequence[str], databases: Sequence[str] | None = None) -> list[str]:
    """Targets given by the caller, else every member of the databases, else no limit."""
    return list(targets) if targets else [f"{d}.*" for d in databases or []]


def parse_targets(targets: Iterable[str]) -> list[tuple[str, str]]:
    """The well-formed patterns (exactly one dot), without repeats."""
    parts = (t.split(".") for t in targets)
    return list(dict.fromkeys((p[0], p[1]) for p in parts if len(p) == 2))


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


def _quoted(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else ""


def matches(value: Column, pattern: str) -> tuple[list[Column], list[Column]]:
    """Conditions that hold if the pattern matches: (those a scan can use, all of them).

    ``*`` alone is anything, else everything but ``*`` is literal, the pattern
    covers the whole value and ``*`` does not run over a newline.
    """
    if pattern == "*":
        return [], []
    if "*" not in pattern:
        return [value == pattern], [value == pattern]
    head, *inner, tail = pattern.split("*")
    inner = [piece for piece in inner if piece]
    pushed = (
        [value.startswith(head)] * bool(head)
        + [value.endswith(tail)] * bool(tail)
        + [value.contains(piece) for piece in inner]
    )
    exact = [*pushed, ~value.contains("\n")]
    if head and tail and not inner:
        exact.append(F.length(value) >= len(head) + len(tail))
    elif len(pushed) > 1:
        exact.append(value.rlike("\\A" + NOT_NEWLINE.join(map(_quoted, pattern.split("*"))) + "\\z"))
    return pushed, exact


def target_predicate(targets: Iterable[str], database: Column, table: Column) -> Column:
    """True where any pattern matches, else false; no patterns means everything, only malformed ones nothing.

    Never null, however many patterns there are: a null name matches a pattern
    whose half is a lone star and nothing else. Plain names are gathered into IN lists. Prefixes, suffixes and inner pieces
    reach the scan: where a pattern also needs a regular expression, which no
    scan can use, the weaker condition stands beside it in the conjunction.
    """
    targets = list(targets)
    if not targets:
        return F.lit(True)
    whole_databases: list[str] = []
    everywhere: list[str] = []
    members: dict[str, list[str]] = {}
    others: list[tuple[str, str]] = []
    for db, tb in parse_targets(targets):
        if db == tb == "*":
            return F.lit(True)
        if "*" not in db and tb == "*":
            whole_databases.append(db)
        elif db == "*" and "*" not in tb:
            everywhere.append(tb)
        elif "*" not in db and "*" not in tb:
            members.setdefault(db, []).append(tb)
        else:
            others.append((db, tb))
    plain = [(database == db) & table.isin(tables) for db, tables in members.items()]
    if whole_databases:
        plain.append(database.isin(whole_databases))
    if everywhere:
        plain.append(table.isin(everywhere))
    if len(others) > MANY and not any("\n" in db + tb for db, tb in others):
        hints = [(matches(database, db)[0] or matches(table, tb)[0] or [F.lit(True)])[0] for db, tb in others]
        return _any(plain + hints) & F.coalesce(_any(plain + _alternatives(others, database, table)), F.lit(False))
    pushed, exact = list(plain), list(plain)
    for db, tb in others:
        (db_pushed, db_exact), (tb_pushed, tb_exact) = matches(database, db), matches(table, tb)
        pushed.append(_all(db_pushed + tb_pushed))
        exact.append(_all(db_exact + tb_exact))
    if not exact:
        return F.lit(False)
    # coalesce keeps the optimizer from factoring out what both parts share,
    # which would leave one disjunction again that no scan can use.
    return _any(pushed) & F.coalesce(_any(exact), F.lit(False))


MANY = 16  # wildcard patterns that still make an expression of their own each


def _alternatives(patterns: list[tuple[str, str]], database: Column, table: Column) -> list[Column]:
    """Wildcard patterns as three regular expressions: on either half, and on both joined.

    The halves are joined by a newline, which neither a star nor, in these
    patterns, a literal can stand for.
    """

    def regex(pattern: str) -> str:
        return NOT_NEWLINE.join(map(_quoted, pattern.split("*")))

    both = F.concat(database, F.lit("\n"), table)
    by_database = [regex(db) for db, tb in patterns if tb == "*"]
    by_table = [regex(tb) for db, tb in patterns if db == "*"]
    by_both = [f"{regex(db)}\n{regex(tb)}" for db, tb in patterns if "*" not in (db, tb)]
    return [
        value.rlike("\\A(?:" + "|".join(found) + ")\\z")
        for value, found in ((database, by_database), (table, by_table), (both, by_both))
        if found
    ]


#: Characters of patterns that one automaton is built of (some 150 bytes of memory for each), and automata that a
#: task holds at a time.
BLOCK_CHARS, BLOCKS = 1 << 18, 4


def target_semi_join(
    df: DataFrame, patterns: DataFrame, database: str, table: str, pattern: str = "pattern", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Rows of ``df`` whose (database, table) matches any pattern of a pattern table, as ``target_predicate`` has it.

    The patterns become automata that the names run through where they are read:
    ``df`` is not moved, so no name and no pattern can be too frequent. An
    automaton holds a bounded part of the table; where there are more than a task
    may hold, the distinct names go by all of them in turn, and patterns without a
    star, of which there may be as many as names, are joined by equality.
    Unlike an empty list of targets, an empty table matches nothing.
    """
    parts = F.split(F.col(pattern), r"\.", -1)
    wanted = patterns.where(F.col(pattern).isNotNull() & (F.size(parts) == 2)).select(
        F.get(parts, F.lit(0)).alias("pd"), F.get(parts, F.lit(1)).alias("pt")
    ).distinct()
    chars = F.sum(F.length("pd") + F.length("pt") + 2)
    if (wanted.agg(chars).first()[0] or 0) <= block_chars * BLOCKS:
        blocks = _blocks(wanted, block_chars)
        return df.where(_any([automaton(b)(F.col(database), F.col(table)) for b in blocks])) if blocks else df.where(F.lit(False))
    starred = F.contains(F.concat("pd", "pt"), F.lit("*"))
    names = df.select(F.col(database).alias("__d"), F.col(table).alias("__t")).distinct()
    plain = wanted.where(~starred).select(F.col("pd").alias("__d"), F.col("pt").alias("__t"))
    hits = names.join(plain, ["__d", "__t"], "left_semi")
    blocks = _blocks(wanted.where(starred), block_chars)
    for first in range(0, len(blocks), BLOCKS):
        some = [automaton(b)(F.col("__d"), F.col("__t")) for b in blocks[first : first + BLOCKS]]
        hits = hits.unionByName(names.where(_any(some)))
    same = F.col(database).eqNullSafe(F.col("__d")) & F.col(table).eqNullSafe(F.col("__t"))
    return df.join(hits.distinct(), same, "left_semi")


def _blocks(wanted: DataFrame, block_chars: int) -> list[list[tuple[str, str]]]:
    """The patterns, each block of them bounded in size and taken over by itself."""
    blocks: list[list[tuple[str, str]]] = []
    size = block_chars
    for row in wanted.toLocalIterator():
        if size >= block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((row.pd, row.pt))
        size += len(row.pd) + len(row.pt) + 2
    return blocks


def automaton(patterns: list[tuple[str, str]]) -> Callable[[Column, Column], Column]:
    """A predicate on (database, table): any of the patterns matches. Two columns go through it, nothing else of a row."""
    shared = SparkSession.active().sparkContext.broadcast(patterns)

    @F.arrow_udf("boolean")
    def matched(databases: pa.Array, tables: pa.Array) -> pa.Array:
        known = _built(shared)
        names = list(zip(databases.to_pylist(), tables.to_pylist()))
        found = {name: known.matches(*name) for name in set(names)}
        return pa.array([found[name] for name in names], pa.bool_())

    return matched


@functools.lru_cache(maxsize=BLOCKS)
def _built(shared) -> PatternAutomaton:
    return PatternAutomaton(shared.value)
