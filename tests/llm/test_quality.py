"""Quality rules: base counts against brute force, estimates against plain numpy, planted outliers."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconcile.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, level string, g string, stats int, n int"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(6)
    pieces = ["a", "b", "é", "日本", "#", "$%", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\r\n", "a b a b a b", "x\ny\nx", "\x85"]
    out = [None, "", " ", "\n", "a", "a\na", "a\n a", "\na\n\na\n", "a b c d e a b c d e", "é " * 50_000, "x\n" * 30_000, "word" * 100_000]
    return out + ["".join(draw.choice(pieces) for _ in range(draw.randrange(60))) for _ in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", 1, 1) for r in rows], SCHEMA)


def test_base_counts(spark, texts):
    rows = [(n, t, "en", "a") for n, t in enumerate(texts)] + [(None, "a b", None, None)] * 2
    result = quality.judge_documents(frame(spark, rows)).collect()
    assert len(result) == len(rows)
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in result}
    for n, t in enumerate(texts):
        assert found[n] == counts(t), repr(t)[:80]
    for r in result:
        n_words, *_, repeated = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (n_words < 10 or 100 * repeated > 20 * n_words)
        assert not (r.base_failed and r.kept)


def prose(draw, words=None):
    names = ["the", "of", "river", "stone", "walks", "green", "house", "over", "quiet", "seven", "paper", "lantern"]
    picked = [draw.choice(names) + str(draw.randrange(3) or "") for _ in range(words or draw.randint(40, 300))]
    return "".join(w.title() + " " if n % 12 == 0 else w + (".\n" if n % 12 == 11 else " ") for n, w in enumerate(picked))


def junk(draw, kind):
    if kind == 0:
        return " ".join("$" * 6 + "#" * draw.randint(3, 9) + str(n) for n in range(80))
    if kind == 1:
        return "".join(chr(draw.randrange(97, 123)) for _ in range(40)).join(str(n) for n in range(60)) + " z" * 3 + prose(draw, 20).upper() * 3
    return " | ".join("".join(draw.choice("XYZW") for _ in range(30)) for _ in range(60))


def test_planted_outliers(spark):
    """A tenth of each source is junk, which pulls plain means but not the robust ones; small groups are judged together."""
    draw = random.Random(2)
    rows, bad = [], set()
    for n in range(2600):
        lang, source = draw.choice([("en", "a")] * 6 + [("de", "b")] * 5 + [(None, "c"), ("fr", f"s{n % 40}")] + [(f"l{n % 30}", None)])
        if draw.random() < 0.1:
            bad.add(n)
        rows.append((n, junk(draw, draw.randrange(3)) if n in bad else prose(draw), lang, source))
    result = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows)).collect()}
    assert Counter(r.level for r in result.values()).keys() >= {"source", "all"}
    clean = [r for n, r in result.items() if n not in bad]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean)
    missed = [n for n in bad if result[n].kept]
    assert len(missed) <= 0.1 * len(bad)
    again = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows).repartition(7)).collect()}
    assert again == result  # sums of whole numbers don't hang on the order


def test_estimates_against_numpy(spark):
    """The estimate is what plain concentration steps end with, from the same vectors, and better than that of all rows."""
    draw = np.random.default_rng(3)
    p = len(quality.NAMES)
    base = draw.normal(size=(1500, p)) @ draw.normal(size=(p, p)) * 150
    base[:200] += 3000
    stats = np.rint(base).astype(int)
    rows = spark.createDataFrame([("g", s.tolist()) for s in stats], "g string, stats array<int>")
    found = quality.robust_estimates(rows, F.xxhash64("stats")).first()
    mean, floor = np.array(found["mean"]), np.eye(p) * (quality.FLOOR * quality.GRID) ** 2
    clean = stats[200:]
    assert np.abs(mean - clean.mean(axis=0)).max() < 60 and np.abs(stats.mean(axis=0) - clean.mean(axis=0)).min() > 100
    inverse, at = np.zeros((p, p)), 0
    for i in range(p):
        for j in range(i + 1):
            inverse[i, j] = inverse[j, i] = found["inverse"][at] / (1 if i == j else 2)
            at += 1
    # One more plain step from here changes next to nothing: it is a fixed point.
    d = np.einsum("ni,ij,nj->n", stats - mean, inverse, stats - mean)
    nearest = stats[np.argsort(d)[: int(np.ceil(quality.SHARE * len(stats)))]]
    assert not (nearest[:, 0] > 2000).all() and np.abs(nearest.mean(axis=0) - mean).max() < 10
    logdet = np.linalg.slogdet(np.cov(nearest.T, bias=True) + floor)[1]
    assert abs(logdet + np.linalg.slogdet(inverse)[1]) < 0.1
    assert np.isclose(np.sqrt(np.sort(d)[int(np.ceil(quality.SHARE * len(stats))) - 1]), found["reach"], rtol=0.02)


def test_too_few_documents_are_not_judged(spark):
    draw = random.Random(1)
    rows = [(n, prose(draw), "en", "a") for n in range(20)] + [(100, junk(draw, 0), "en", "a")]
    result = quality.judge_documents(frame(spark, rows)).collect()
    assert all(r.kept != r.base_failed and r.level is None and r.distance is None for r in result)
    empty = quality.judge_documents(frame(spark, []))
    assert empty.count() == 0 and {"doc_id", "n_words", "base_failed", "kept"} <= set(empty.columns)
