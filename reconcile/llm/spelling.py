"""Spelling variant grouping over a variable-length gram index.

A dictionary of grams is made from the words: all grams of two letters, and longer
ones only where the shorter one in front is among the most frequent. A word is cut
into the longest dictionary gram at each letter, without those that lie within
another. For every place of an edit the grams that it may affect are known from
the dictionary alone, by the letters on its two sides: those that hold the place,
those that could grow over it, and those that a gram grown over it would swallow.
The others are the same in both words of a pair, at the same distance from the
start or the end. So a word is listed under its unaffected grams of each place of an
edit, words meet in the merged list of all grams that they must share, and those that meet
are compared letter by letter.

Lists of more than ``LONG`` words are not compared: their words are cut anew into
grams of two letters, so that next to nothing but the edited letter is free, and the alphabet
bounds a list.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reconcile.llm.storage import cut, few
from reconcile.llm.tokens import mix, slices

#: Fixed values of the words: fewest letters and occurrences, the share of runs that lose a letter, dominance.
SHORTEST, RAREST, SPOILED, TIMES = 6, 5, 199, 5
#: Longest gram (never more than half a word), grams that are extended, words of a list that are compared as they are.
LONGEST, EXTENDED, LONG = 4, 4096, 256
#: Bytes of text, pairs and listed words held at a time.
SLICE_BYTES, PAIRS, LISTED = 1 << 22, 1 << 18, 1 << 17
#: Letters are coded 0 to 89: a to z, then U+00C0 to U+00FF.
ALPHABET = 90


def corpus_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least 6 letters that occur at least 5 times in docs.

    Runs of letters, A to Z lower-cased; one run in 199, told by a checksum of id and run, loses
    a letter. A null text has none, a null id counts as an empty one.
    """
    given = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text))
    counts = given.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= RAREST)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).fill_null("").cast(pa.large_string())
        for start, end in slices(texts, SLICE_BYTES):
            words = _words_of(batch.column(0).slice(start, end - start).to_pylist(), texts.slice(start, end - start))
            found = pa.chunked_array(words, pa.large_string()).value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])


def _words_of(ids: list[str], texts: pa.Array) -> list[pa.Array]:
    """The words of at least SHORTEST letters, those that lost a letter apart."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if offsets[-1] == offsets[0]:
        return []
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # U+00C0 to U+00FF are 0xC3 and another byte.
    second = np.append(False, data[:-1] == 0xC3)
    inside = _LETTER[data] | second
    joined = inside[1:] & inside[:-1]
    joined[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False  # a text's end parts runs
    begin = np.flatnonzero(inside & ~np.append(False, joined))
    end = np.flatnonzero(inside & ~np.append(joined, False)) + 1
    if not len(begin):
        return []
    data = _LOWER[data]
    row = np.searchsorted(offsets, begin, "right") - 1
    checksum = _crc32(np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[row], data, begin, end)
    letters = (end - begin) - _ranges(second, begin, end)
    spoiled = checksum % SPOILED == 0
    shorter = []
    for at in np.flatnonzero(spoiled):
        run = data[begin[at] : end[at]].tobytes().decode()
        gone = int(checksum[at]) % len(run)
        if len(run) > SHORTEST:
            shorter.append(run[:gone] + run[gone + 1 :])
    whole = ~spoiled & (letters >= SHORTEST)
    begin, end = begin[whole], end[whole]
    lengths = end - begin
    kept = np.zeros(len(data) + 1, np.int8)
    kept[begin] += 1
    kept[end] -= 1
    held = data[np.cumsum(kept[:-1], dtype=np.int8) > 0]
    places = np.append(0, np.cumsum(lengths))
    array = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(held)])
    return [array, pa.array(shorter, pa.large_string())]


def _ranges(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[end] - sums[begin]


def _crc32(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, carried on from a checksum: byte by byte over all runs, longest first."""
    lengths = end - begin
    order = np.argsort(-lengths, kind="stable")
    state, at, left = ~state[order], begin[order], -lengths[order]
    common = 64
    for place in range(min(common, int(lengths.max(initial=0)))):
        active = int(np.searchsorted(left, -place, "left"))
        now = state[:active]
        state[:active] = _CRC[(now ^ data[at[:active] + place]) & 0xFF] ^ (now >> np.uint32(8))
    state = ~state
    for long in range(int(np.searchsorted(left, -common, "left"))):
        rest = data[at[long] + common : at[long] - left[long]]
        state[long] = zlib.crc32(rest.tobytes(), int(state[long]))
    result = np.empty_like(state)
    result[order] = state
    return result


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def gram_dictionary(words: DataFrame, longest: int = LONGEST, extended: int = EXTENDED) -> list[str]:
    """Grams of 3 to ``longest`` letters whose shorter grams in front are all among the ``extended`` most frequent.

    All grams of two letters belong to the dictionary too, without being listed. It has at most
    ``extended`` times 90 entries for each length, whatever the words are.
    """
    kept: list[str] = []
    frequent = None
    for size in range(2, longest):
        counts = _grams(words, size)
        if frequent is not None:
            counts = counts.join(F.broadcast(frequent), F.substring("gram", 1, size - 1) == F.col("front"), "left_semi")
        top = cut(counts.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(extended))
        frequent = top.select(F.col("gram").alias("front"))  # at most ``extended`` rows
        longer = _grams(words, size + 1).join(F.broadcast(frequent), F.substring("gram", 1, size) == F.col("front"), "left_semi")
        kept += [row.gram for row in longer.distinct().collect()]  # at most 90 for each frequent gram
    return kept


def _grams(words: DataFrame, size: int) -> DataFrame:
    places = F.sequence(F.lit(1), F.length("word") - size + 1)
    return words.select(F.explode(F.transform(places, lambda p: F.substring(F.col("word"), p, size))).alias("gram"))


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 192, points - 97, points - 192 + 26)


def _number(columns: list[np.ndarray]) -> np.ndarray:
    total = columns[0]
    for column in columns[1:]:
        total = total * ALPHABET + column
    return total


class Grams:
    """The dictionary for words whose longest gram has ``longest`` letters: what is in it, what grows, what ends so."""

    def __init__(self, grams: list[str], longest: int):
        self.longest = longest
        coded = [_codes(g) for g in grams if len(g) <= longest]
        self.known = {size: np.unique([_number(list(g)) for g in coded if len(g) == size] or [-1]) for size in range(3, longest + 1)}
        # Beginnings of two letters or more of longer grams, and ends of longer grams.
        self.grows = {size: np.unique([_number(list(g[:size])) for g in coded if len(g) > size] or [-1]) for size in range(2, longest)}
        self.ends = {size: np.unique([_number(list(g[-size:])) for g in coded if len(g) > size] or [-1]) for size in range(2, longest)}

    def lists(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams in front of letter i and behind, untouched by an edit there, for a matrix of words.

        Column i of the first (0 to n) is for an edit that leaves the first i letters as
        they are, column j of the second for one that leaves the letters from j on.
        """
        rows, n = m.shape
        runs = {size: _number([m[:, k : n - size + 1 + k] for k in range(size)]) for size in range(2, self.longest + 1) if size <= n}
        size_at = np.full((rows, n - 1), 2)
        gram_at = runs[2].copy()
        reach = np.ones(gram_at.shape, bool)
        for size in range(3, self.longest + 1):
            # A longer gram counts where the shorter one in front of it is known too.
            width = n - size + 1
            reach = reach[:, :width] & _in(runs[size], self.known[size])
            size_at[:, :width][reach] = size
            gram_at[:, :width][reach] = runs[size][reach] + size * ALPHABET**5
        ends = np.arange(n - 1) + size_at
        furthest = np.maximum.accumulate(ends, axis=1)
        outer = np.ones(ends.shape, bool)
        outer[:, 1:] = ends[:, 1:] > furthest[:, :-1]
        # Sums of hashes of grams with their places, from the start and from the end.
        place = np.arange(n - 1, dtype=np.uint64)
        name = (gram_at + 1).astype(np.uint64) * np.uint64(1 << 20)
        front = np.where(outer, mix(name + place), np.uint64(0))
        back = np.where(outer, mix(~(name + np.uint64(n) - place)), np.uint64(0))
        front = np.hstack([np.zeros((rows, 1), np.uint64), np.cumsum(front, axis=1)])
        back = np.hstack([np.cumsum(back[:, ::-1], axis=1)[:, ::-1], np.zeros((rows, 1), np.uint64)])
        # In front of i: grams up to the first place from which one could grow over i.
        before = np.zeros((rows, n + 1), np.uint64)
        for i in range(1, n + 1):
            first = np.full(rows, i - 1)  # any letter can begin a gram of two
            for size in range(2, self.longest):
                if size <= i:
                    first[_in(runs[size][:, i - size], self.grows[size])] = i - size
            before[:, i] = front[np.arange(rows), first]
        # Behind j: grams that end past all that one reaching in from before j could.
        behind = np.zeros((rows, n + 1), np.uint64)
        for j in range(n - 1):
            past = np.full(rows, j + 1)
            for size in range(2, self.longest):
                if j + size <= n:
                    past[_in(runs[size][:, j], self.ends[size])] = j + size
            first = np.full(rows, n - 1)
            for p in range(min(j + self.longest, n - 2), j - 1, -1):
                first[furthest[:, p] > past] = p
            behind[:, j] = back[np.arange(rows), first]
        return before, behind


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


SAME, SHORT, LONGER = 0, 1, 2


def _listed(grams: list[str], longest: int):
    """word, n -> list, role, low, high, word, n: the lists of a word, each with the places of an edit that it stands for.

    ``SAME`` are lists for another word of the same length, ``LONGER`` those that a
    word with one letter less has as ``SHORT``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries = {size: Grams(grams, size) for size in range(2, longest + 1)}
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            for n in np.unique(lengths):
                same = np.flatnonzero(lengths == n)
                for start in range(0, len(same), max(1, LISTED // (4 * int(n)))):
                    rows = same[start : start + max(1, LISTED // (4 * int(n)))]
                    yield from _lists_of(dictionaries, longest, batch.take(pa.array(rows)), np.stack([_codes(words[r]) for r in rows]))

    return run


def _lists_of(dictionaries: dict[int, Grams], longest: int, batch: pa.RecordBatch, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = m.shape[1]
    before, behind = dictionaries[min(longest, n // 2)].lists(m)
    kinds = [(SAME, n, before[:, :-1], behind[:, 1:]), (SHORT, n, before, behind)]
    if n > SHORTEST:
        if min(longest, n // 2) != min(longest, (n - 1) // 2):
            before, behind = dictionaries[min(longest, (n - 1) // 2)].lists(m)
        kinds.append((LONGER, n - 1, before[:, :-1], behind[:, 1:]))
    for role, length, left, right in kinds:
        name = mix(mix(left + np.uint64(length)) + right + np.uint64(role > 0))
        # Neighbouring places with the same lists are one row.
        new = np.ones(name.shape, bool)
        new[:, 1:] = name[:, 1:] != name[:, :-1]
        row, low = np.nonzero(new)
        high = np.append(low[1:], 0) - 1
        high[np.append(row[1:] != row[:-1], True)] = name.shape[1] - 1
        arrays = [
            pa.array(name[row, low].view(np.int64)), pa.array(np.full(len(row), role, np.int8)), pa.array(low.astype(np.int32)),
            pa.array(high.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["list", "role", "low", "high", "word", "n"])


LISTS = "list long, role byte, low int, high int, word string, n long"


def near_words(words: DataFrame, longest: int = LONGEST, long: int = LONG) -> DataFrame:
    """word, near, near_n: each ordered pair of words (word, n) that differ by one letter inserted, deleted or replaced."""
    grams = gram_dictionary(words, longest)
    listed = cut(words.mapInArrow(_listed(grams, longest), LISTS))
    hot = cut(listed.groupBy("list").agg(F.count("*").alias("rows")).where(F.col("rows") > long).select("list"))
    if hot.isEmpty():
        return _compared(listed)
    pairs = _compared(listed.join(few(hot), "list", "left_anti"))
    crowded = listed.join(few(hot), "list", "left_semi").select("word", "n").distinct()
    # The words of long lists, by grams of two letters. A pair that shares a short list too comes twice.
    again = _compared(crowded.mapInArrow(_listed([], 2), LISTS))
    return pairs.unionByName(again).distinct()


def _compared(listed: DataFrame) -> DataFrame:
    lists = listed.repartition("list").sortWithinPartitions("list", "role")
    return lists.mapInArrow(_pairs, "word string, near string, near_n long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within lists, which come one behind the other."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= LISTED:
            table = pa.Table.from_batches(held).combine_chunks()
            # The last list may go on.
            name = table.column(0).to_numpy()
            end = int(np.append(0, np.flatnonzero(name != name[-1]) + 1)[-1])
            yield from _pairs_of(table.slice(0, end))
            held = table.slice(end).to_batches()
            rows -= end
    if rows:
        yield from _pairs_of(pa.Table.from_batches(held))


def _pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    table = table.combine_chunks()
    name, role, low, high = (table.column(c).to_numpy() for c in range(4))
    # Lists of one word have nothing to compare.
    starts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    sizes = np.diff(np.append(starts, len(name)))
    used = np.repeat(sizes > 1, sizes)
    table = table.filter(pa.array(used))
    name, role, low, high = name[used], role[used], low[used], high[used]
    if not len(name):
        return
    words = table.column(4).to_pylist()
    lengths = np.array([len(w) for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.append(np.flatnonzero(name[1:] != name[:-1]) + 1, len(name))
    left = ends[np.searchsorted(ends, np.arange(len(name)), "right")] - np.arange(len(name)) - 1
    pending, count = [], 0
    for apart in range(1, int(left.max()) + 1):
        a = np.flatnonzero(left >= apart)
        b = a + apart
        # Roles are sorted within a list: the same, or the shorter in front of the longer.
        fits = ((role[a] == SAME) & (role[b] == SAME)) | ((role[a] == SHORT) & (role[b] == LONGER))
        pending.append((b[fits], a[fits]))  # the longer word first
        count += int(fits.sum())
        if count >= PAIRS:
            yield from _near(table, letters, first, lengths, low, high, pending)
            pending, count = [], 0
    if count:
        yield from _near(table, letters, first, lengths, low, high, pending)


def _near(table: pa.Table, letters, first, lengths, low, high, pending) -> Iterator[pa.RecordBatch]:
    all_a, all_b = (np.concatenate(side) for side in zip(*pending))
    # Pairs of like length are compared together, so that one long word makes no wide matrix.
    width = np.int64(1) << np.ceil(np.log2(np.maximum(lengths[all_a], 8))).astype(np.int64)
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        step = max(1, (1 << 22) // int(w))
        for start in range(0, len(chosen), step):
            a, b = all_a[chosen[start : start + step]], all_b[chosen[start : start + step]]
            alike, other = _agreement(letters, first, lengths, a, b, int(w))
            # Letters that agree from the start and from the end leave just the edited one.
            near = (alike + other >= lengths[a] - 1) & (alike < lengths[a])
            # The place of the edit is one that both lists stand for, so that a pair comes from one list only.
            near &= (low[a] <= alike) & (alike <= high[a]) & (low[b] <= alike) & (alike <= high[b])
            a, b = pa.array(a[near]), pa.array(b[near])
            for x, y in ((a, b), (b, a)):
                columns = [table.column(4).take(x), table.column(4).take(y), table.column(5).take(y)]
                yield from pa.Table.from_arrays(columns, ["word", "near", "near_n"]).to_batches()


def _agreement(letters, first, lengths, a, b, w) -> tuple[np.ndarray, np.ndarray]:
    """Equal letters at the start and at the end of words a and b (b not longer)."""
    place = np.arange(w)
    short = lengths[b][:, None]
    end = len(letters) - 1
    differ = letters[np.minimum(first[a][:, None] + place, end)] != letters[np.minimum(first[b][:, None] + place, end)]
    differ |= place >= short
    alike = np.where(differ.any(axis=1), differ.argmax(axis=1), w)
    last_a, last_b = first[a][:, None] + lengths[a][:, None] - 1, first[b][:, None] + short - 1
    differ = letters[np.maximum(last_a - place, 0)] != letters[np.maximum(last_b - place, 0)]
    differ |= place >= short
    return alike, np.where(differ.any(axis=1), differ.argmax(axis=1), w)


def group_spellings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs, see ``corpus_words``.

    ``form`` is the near word with the most occurrences (ties: the first by code
    point) if it has at least five times the word's, ``root`` the end of the chain of
    forms. Repeated rows count each; an empty table gives an empty result; a word that runs through
    a very long text is as good as any.
    """
    words = cut(corpus_words(docs, id, text))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    formed = words.join(near, "word", "left")
    chosen = F.col("best.near").isNotNull() & (-F.col("best.n") >= TIMES * F.col("n"))
    formed = cut(formed.select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, -F.col("best.n")).alias("form_n"),
    ))
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """word, root of the words with a form. A form has five times its word's occurrences, so chains are short."""
    links = cut(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = formed.agg(F.max("n")).first()[0] or 1  # one number
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log(most, TIMES)))))):
        # Each round doubles the part of the chain that is behind.
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("end"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("end", "root").alias("root")))
    return links
