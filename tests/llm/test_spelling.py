"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reconcile.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n int, list string"


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near_pairs(words):
    """By leaving out each letter."""
    without, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            without[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for alike in without.values():
        for w in alike:
            near[w] |= alike - {w}
    return near


def expected(rows):
    counts = counted(rows)
    near, form = near_pairs(counts), {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "own", 1, "own") for r in rows], SCHEMA)
    result = spelling.group_spellings(docs).collect()
    assert len({r.word for r in result}) == len(result)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in result}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    stems = ["".join(draw.choice("abetÀéÿ×") for _ in range(draw.randint(5, 14))) for _ in range(40)] + ["nation", "stations", "ß" * 80, "e" * 300]
    out = [(None, None), (1, ""), (2, " 12 ,.\n"), (3, "x"), (None, "Nation nation nation")]
    for n in range(900):
        words = []
        for _ in range(30):
            w = min(draw.choice(stems), draw.choice(stems))
            for _ in range(draw.choice([0, 0, 0, 0, 1, 2])):
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abeté") + w[at:], w[:at] + draw.choice("abeté") + w[at + 1 :]]) or w
            words.append(draw.choice([w, w.upper(), w.title()]))
        out.append((draw.choice([n, n, None, 7]), draw.choice([" ", "-", "1", "\n", "ā", "日"]).join(words)))
    out += [(n, "stationss stationss") for n in range(300)] + [(n, "stationsss") for n in range(50)]  # a chain
    return out + [(9, "stations," * 40_000), (10, "long" * 30_000)] + out[5:25]  # repeated rows count each


def test_against_brute_force(spark, texts):
    want = expected(texts)
    assert found(spark, texts) == want
    assert sum(w[0] is not None for w in want.values()) > 50 and any(w[0] != w[1] for w in want.values() if w[0])


def test_long_lists_go_by_smaller_grams(spark, texts):
    words = {w: n for w, n in counted(texts).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(w, v, words[v]) for w, others in near_pairs(words).items() for v in others}
    for long in (1, 3, 10**6):
        pairs = [tuple(r) for r in spelling.near_words(df, long=long).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_near_words_of_every_length_share_a_list(longest):
    """For each place of an edit both words have the list that stands for it, whatever the dictionary."""
    draw = random.Random(longest)
    letters = "abc"
    grams = list({"".join(draw.choice(letters) for _ in range(size)) for size in (3, 4) for _ in range(12)})
    grams += [g[:3] for g in grams if len(g) == 4]
    known = spelling.Grams(grams, longest)
    code = lambda w: spelling._codes(w)[None, :]
    for _ in range(2000):
        n = draw.randint(max(6, 2 * longest), 12)
        w = "".join(draw.choice(letters) for _ in range(n))
        i = draw.randrange(n)
        v = w[:i] + draw.choice(letters) + w[i + 1 :]
        (before, behind), (before_v, behind_v) = known.lists(code(w)), known.lists(code(v))
        assert before[0, i] == before_v[0, i] and behind[0, i + 1] == behind_v[0, i + 1]
        assert before[0, i] or behind[0, i + 1]  # a list of its own: some gram is never affected
        longer = w[:i] + draw.choice(letters) + w[i:]
        before_l, behind_l = known.lists(code(longer))
        assert before[0, i] == before_l[0, i] and behind[0, i] == behind_l[0, i + 1]


def test_checksums():
    runs = [b"", b"a", b"abc" * 5, b"x" * 1000, b"y" * 64, b"z" * 65]
    data = np.frombuffer(b"".join(runs), np.uint8)
    end = np.cumsum([len(r) for r in runs])
    state = np.array([zlib.crc32(b"17:")] * len(runs), np.uint32)
    found_ = spelling._crc32(state, data, end - np.array([len(r) for r in runs]), end)
    assert found_.tolist() == [zlib.crc32(b"17:" + r) for r in runs]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    result = spelling.group_spellings(docs)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"] and result.count() == 0
    assert found(spark, [(1, "short words"), (2, None)]) == {}
