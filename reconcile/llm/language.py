"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read each window of bytes, one in each direction.
At every position both states together give the probability of each language;
a document's probability is the mean over all its positions. Training is
backpropagation through time on a bounded sample. Gates and candidate use
x / (1 + |x|) as their squashing function, which costs a division in place of exponentials.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
#: Bytes of a window (states start anew in each), units of each direction, windows looked at together.
WINDOW, UNITS, TOGETHER = 64, 8, 4096
#: The sample to learn from: documents of each language (as expected), and windows of each.
DOCUMENTS, WINDOWS = 1000, 4
STEPS, BATCH, RATE, SEED = 350, 256, 0.02, 5
#: Pooled probability below which a document counts as of no language.
LEAST_SCORE = 0.4
_PAD = 256


def _squash(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    np.abs(x, out=spare)
    spare += 1
    return np.divide(x, spare, out=out)


@dataclass
class Network:
    """``tables[d]`` has what a byte adds to update gate, reset gate and candidate in direction d (the bias is in
    it), ``weights[d]`` what the state before adds; ``out`` and ``bias`` turn both states into languages."""

    languages: list[str]
    tables: list[list[np.ndarray]]
    weights: list[list[np.ndarray]]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(languages: list[str], units: int = UNITS, seed: int = SEED) -> Network:
        random = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        return Network(
            languages, [[normal(_PAD + 1, units) * 4 for _ in range(3)] for _ in range(2)],
            [[normal(units, units) for _ in range(3)] for _ in range(2)],
            normal(2 * units, len(languages)), np.zeros(len(languages), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables[0], *self.tables[1], *self.weights[0], *self.weights[1], self.out, self.bias]

    def states(self, columns: np.ndarray, direction: int) -> np.ndarray:
        """The state at every position of windows given as (position, window) bytes."""
        places, many = columns.shape
        units = self.weights[0][0].shape[0]
        states = np.empty((places, many, units), np.float32)
        state = np.zeros((many, units), np.float32)
        update, reset, made, spare = (np.empty((many, units), np.float32) for _ in range(4))
        (tz, tr, tn), (wz, wr, wn) = self.tables[direction], self.weights[direction]
        for t in range(places) if direction == 0 else reversed(range(places)):
            for gate, table, weight in ((update, tz, wz), (reset, tr, wr)):
                np.matmul(state, weight, out=gate)
                gate += table.take(columns[t], 0, out=spare, mode="clip")
                _squash(gate, gate, spare)
                gate *= 0.5
                gate += 0.5
            reset *= state
            np.matmul(reset, wn, out=made)
            made += tn.take(columns[t], 0, out=spare, mode="clip")
            _squash(made, made, spare)
            made -= state
            made *= update
            state = np.add(state, made, out=states[t])
        return states

    def probabilities(self, columns: np.ndarray) -> np.ndarray:
        """(position, window, language) probabilities."""
        units = self.weights[0][0].shape[0]
        scores = self.states(columns, 0) @ self.out[:units] + self.states(columns, 1) @ self.out[units:]
        scores += self.bias
        scores -= scores.max(axis=-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        return scores

    def gradients(self, columns: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions that hold a byte, and its gradients in the order of ``arrays``."""
        places, many = columns.shape
        units = self.weights[0][0].shape[0]
        both = [self.states(columns, d) for d in (0, 1)]
        scores = both[0] @ self.out[:units] + both[1] @ self.out[units:] + self.bias
        scores -= scores.max(axis=-1, keepdims=True)
        chances = np.exp(scores)
        chances /= chances.sum(axis=-1, keepdims=True)
        held = (columns != _PAD)[:, :, None].astype(np.float32)
        total = float(held.sum())
        picked = np.take_along_axis(chances, np.broadcast_to(labels[None, :, None], (places, many, 1)), -1)
        loss = float(-(np.log(picked + 1e-9) * held).sum() / total)
        error = chances
        np.put_along_axis(error, np.broadcast_to(labels[None, :, None], (places, many, 1)), picked - 1, -1)
        error *= held / total
        flat = error.reshape(-1, error.shape[-1])
        out = np.concatenate([b.reshape(-1, units).T @ flat for b in both])
        tables, weights = [], []
        for d in (0, 1):
            above = error @ self.out[d * units : (d + 1) * units].T
            t_grads = [np.zeros_like(t) for t in self.tables[d]]
            w_grads = [np.zeros_like(w) for w in self.weights[d]]
            (tz, tr, tn), (wz, wr, wn) = self.tables[d], self.weights[d]
            back = np.zeros((many, units), np.float32)
            zero = back.copy()
            steps = []
            for t in reversed(range(places)) if d == 0 else range(places):
                before = t - 1 if d == 0 else t + 1
                state = both[d][before] if 0 <= before < places else zero
                byte = columns[t]
                z = state @ wz + tz[byte]
                r = state @ wr + tr[byte]
                slope_z, slope_r = 0.5 / (1 + np.abs(z)) ** 2, 0.5 / (1 + np.abs(r)) ** 2
                z, r = 0.5 + 0.5 * z / (1 + np.abs(z)), 0.5 + 0.5 * r / (1 + np.abs(r))
                gated = r * state
                n = gated @ wn + tn[byte]
                slope_n = 1 / (1 + np.abs(n)) ** 2
                n = n / (1 + np.abs(n))
                back = back + above[t]
                dn = back * z * slope_n
                dz = back * (n - state) * slope_z
                through = dn @ wn.T
                dr = through * state * slope_r
                for grad, left, right in zip(w_grads, (state, state, gated), (dz, dr, dn)):
                    grad += left.T @ right
                steps.append((byte, dz, dr, dn))
                back = back * (1 - z) + through * r + dz @ wz.T + dr @ wr.T
            bytes_seen = np.concatenate([s[0] for s in steps]).astype(np.int64)
            order = np.argsort(bytes_seen, kind="stable")
            seen, starts = np.unique(bytes_seen[order], return_index=True)
            for k in range(3):
                t_grads[k][seen] = np.add.reduceat(np.concatenate([s[k + 1] for s in steps])[order], starts)
            tables += t_grads
            weights += w_grads
        return loss, [*tables, *weights, out, error.sum(axis=(0, 1))]


def windows_of(texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """(position, text) bytes of short texts, padded."""
    columns = np.full((window, len(texts)), _PAD, np.int16)
    for i, text in enumerate(texts):
        data = np.frombuffer(text[:window], np.uint8)
        columns[: len(data), i] = data
    return columns


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = SEED, units: int = UNITS) -> Network | None:
    """A network for the labels of these windows, drawn equally often; None if there are none."""
    languages = sorted({label for label, _ in samples})
    if not languages:
        return None
    network = Network.new(languages, units, seed)
    columns = windows_of([text for _, text in samples])
    places = [np.flatnonzero([label == x for label, _ in samples]) for x in languages]
    random = np.random.default_rng(seed)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in network.arrays()]
    for step in range(1, steps + 1):
        labels = random.integers(0, len(languages), BATCH)
        chosen = np.asarray([places[x][random.integers(len(places[x]))] for x in labels])
        _, gradients = network.gradients(columns[:, chosen], labels)
        size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for array, gradient, (mean, square) in zip(network.arrays(), gradients, moments):
            gradient = gradient * min(1.0, 1.0 / (size + 1e-9))
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            array -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return network


def pooled(network: Network, texts: pa.Array) -> np.ndarray:
    """Mean probability of each language over all bytes of each text; zeros for an empty one."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sums = np.zeros((len(texts), len(network.languages)))
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    ends = np.cumsum(counts)
    for low in range(0, int(ends[-1]) if len(ends) else 0, TOGETHER):
        number = np.arange(low, min(low + TOGETHER, ends[-1]))
        row = np.searchsorted(ends, number, side="right")
        start = offsets[row] + (number - (ends[row] - counts[row])) * WINDOW
        held = np.minimum(offsets[row + 1] - start, WINDOW)
        at = start[None, :] + np.arange(WINDOW)[:, None]
        inside = np.arange(WINDOW)[:, None] < held[None, :]
        columns = np.where(inside, data[np.minimum(at, len(data) - 1)], _PAD).astype(np.intp)
        chances = network.probabilities(columns)
        by_window = np.einsum("pwl,pw->wl", chances, inside.astype(np.float32))
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sums[row[first]] += np.add.reduceat(by_window.astype(np.float64), first)
    return sums / np.maximum(lengths, 1)[:, None]


def draw(docs: DataFrame, may_learn: Column, documents: int = DOCUMENTS, windows: int = WINDOWS) -> list[tuple[str, bytes]]:
    """Windows to learn from: of each language about ``documents`` documents, those with the least hashes of
    doc_id, and ``windows`` places of each, by hash. Only text, language and which rows may be used count."""
    taught = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "lang", "text")
    sizes = {row["lang"]: row["count"] for row in docs.where(may_learn & F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not sizes:
        return []
    share = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / float(1 << 53)
    wanted = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, documents / n))))
    chosen = taught.where(share < F.try_element_at(wanted, F.col("lang")))
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    cuts = [F.col("text").substr((F.pmod(F.xxhash64(F.lit(i), "doc_id"), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows)]
    rows = chosen.select("lang", F.array(*cuts).alias("cuts"), "doc_id").orderBy("lang", "doc_id", "cuts").collect()
    return [(row["lang"], cut.encode()) for row in rows for cut in row["cuts"] if cut]


def predictor(network: Network | None):
    """A function of a text column that gives lang_pred and score."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        if network is None or not len(texts):
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts))], ["lang_pred", "score"])
        chances = pooled(network, texts)
        best = chances.argmax(axis=1)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        names = [network.languages[b] if known else UNKNOWN for b, known in zip(best, letters)]
        scores = np.clip(np.where(letters, chances[np.arange(len(best)), best], 0.0), 0.0, 1.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return predict


def with_language(docs: DataFrame, may_learn: Column, into: str = "language") -> DataFrame:
    """docs with a struct column ``into`` of lang_pred and score, for every row.

    The network learns from rows with text and language that ``may_learn``; it
    predicts from the bytes of the whole text alone. A text that is null or has no
    letter is ``und`` with score 0, and so is every one if there is nothing to
    learn from. Repeated rows get the same prediction. A column of docs named
    ``into`` is replaced, other columns stay.
    """
    network = train(draw(docs, may_learn))
    return docs.withColumn(into, predictor(network)(F.col("text")))


def in_known_language(docs: DataFrame, may_learn: Column, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, columns unchanged, in a language that the network knows, with a score of ``least`` or more."""
    labelled = with_language(docs, may_learn, "_language")
    return labelled.where((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least)).drop("_language")
