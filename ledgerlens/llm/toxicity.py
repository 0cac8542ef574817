"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as two vectors: one of its own (if the training sample has it in several texts) and the mean of those of its three- and four-byte pieces (word ends marked), so
an unseen form is read by its pieces. Two gated recurrent units run over a window of words, forwards and backwards; attention
weighs their states, and the pooled state gives the window's logit. All overlapping windows of a whole text are scored; the highest logit,
calibrated on a part of the training sample that the network has not seen, is the text's score.

The network is trained in numpy on a bounded sample of labelled texts. A label belongs to a text, not to its windows, so training
first gives every window its text's label, then takes all windows of the clean texts and of a toxic text the highest only. Words meet their windows' vectors
through the distinct words of a block: input projections are computed once per distinct word.

Defined cases: null and wordless texts are scored like a text without any word (one window of padding); without labelled rows every
score is 0. Repeated rows and ids give a row each; if an id has several labels, one toxic label counts, and if it has several texts, training takes the
one with the smallest hash, so the bound of the sample holds however often an id repeats. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.samples import bounded
from ledgerlens.llm.words import LETTER_LOWER, Words, blocks, mix, text_bytes, words_of

WINDOW, STRIDE = 48, 36
#: Windows that are scored at once, and that a step learns from.
CHUNK, BATCH = 1024, 64
HIDDEN, WORD, PIECE = 8, 8, 8
#: Bounds of the training sample: texts of each label, and windows of a text.
TRAIN_TEXTS, TRAIN_WINDOWS = 1200, 12
#: A word or piece has a vector of its own if so many texts of the sample have it, and this share of them. Decay of those vectors.
KEY_TEXTS, KEY_SHARE, DECAY = 4, 0.01, 0.1
#: Texts whose words are counted at once.
KEY_STEP = 100
#: Texts of each label that a calibration on texts kept back needs; with fewer all texts calibrate.
KEPT_BACK = 30
F32 = np.float32


def pieces_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the three- and four-byte pieces of each word with its ends marked, and their bounds by word."""
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(first[-1] + 3, np.uint64)
    owner = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(first[-1]) - first[:-1][owner] - 1
    middle = (inner >= 0) & (inner < (ends - starts)[owner])
    marked[: first[-1]][middle] = data[(starts[owner] + inner)[middle]]
    marked[: first[-1]][inner < 0] = 1
    marked[: first[-1]][~middle & (inner >= 0)] = 2
    left = first[1:][owner] - np.arange(first[-1])
    three = marked[:-3] | marked[1:-2] << np.uint64(8) | marked[2:-1] << np.uint64(16)
    four = three | marked[3:] << np.uint64(24) | np.uint64(1 << 32)
    values = np.stack([three, four], axis=1)
    valid = np.stack([left >= 3, left >= 4], axis=1)
    return mix(values[valid]), np.concatenate([[0], np.cumsum(np.bincount(np.repeat(owner, 2)[valid.reshape(-1)], minlength=len(starts)))])


def window_rows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of every window (-1: none) and the bounds of the windows by text; a text has at least one."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    start = (np.arange(first[-1]) - first[:-1][owner]) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < n[owner][:, None], offsets[:-1][owner][:, None] + place, -1), first


def slots_in(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in the sorted keys; the number of keys for one that is not there."""
    if not len(keys):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, len(keys))


class Vocabulary:
    """The distinct words of a block: their slots and pieces, and the distinct word at each word position."""

    def __init__(self, data: np.ndarray, words: Words, word_keys: np.ndarray, piece_keys: np.ndarray):
        values, at, self.inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.slots = slots_in(word_keys, values)
        pieces, self.bounds = pieces_of(data, words.starts[at], words.ends[at])
        self.pieces = slots_in(piece_keys, pieces)

    def rows(self, places: np.ndarray) -> np.ndarray:
        """Distinct words at the places; one past the last stands for none."""
        return np.append(self.inverse, len(self.slots))[places]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    word_keys: np.ndarray
    piece_keys: np.ndarray
    values: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, seed: int, word_keys: np.ndarray, piece_keys: np.ndarray) -> Network:
        rng = np.random.default_rng(seed)
        near = lambda *shape, scale: rng.normal(0, scale, shape).astype(F32)
        v = {"word": near(len(word_keys) + 1, WORD, scale=0.1), "piece": near(len(piece_keys) + 1, PIECE, scale=0.3)}
        v["word"][-1] = v["piece"][-1] = 0
        for d in "fb":
            v |= {f"in_{d}": near(WORD + PIECE, 3 * HIDDEN, scale=0.3), f"bias_{d}": np.zeros(3 * HIDDEN, F32), f"state_{d}": near(HIDDEN, 3 * HIDDEN, scale=0.3),
                  f"attend_{d}": near(HIDDEN, scale=0.5), f"out_{d}": near(HIDDEN, scale=0.5)}
        return cls(word_keys, piece_keys, v | {"out_bias": np.zeros(1, F32)})

    def inputs(self, words: Vocabulary) -> np.ndarray:
        """The input vector of each distinct word, and zeros for none."""
        v = self.values
        out = np.zeros((len(words.slots) + 1, WORD + PIECE), F32)
        if len(words.slots):
            out[:-1, :WORD] = v["word"][words.slots]
            out[:-1, WORD:] = np.add.reduceat(v["piece"][words.pieces], words.bounds[:-1], axis=0) / np.diff(words.bounds)[:, None]
        return out

    def run(self, d: str, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction: steps x HIDDEN x windows. rows: steps x windows; ``keep`` collects what learning needs."""
        projected = x @ self.values[f"in_{d}"] + self.values[f"bias_{d}"]
        state = np.ascontiguousarray(self.values[f"state_{d}"].T)
        h = np.zeros((HIDDEN, rows.shape[1]), F32)
        out = np.empty((len(rows), HIDDEN, rows.shape[1]), F32)
        for t in range(len(rows)) if d == "f" else range(len(rows) - 1, -1, -1):
            g = np.ascontiguousarray(projected.take(rows[t], axis=0).T)
            u = state @ h
            gates = g[: 2 * HIDDEN]
            gates += u[: 2 * HIDDEN]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r, un = gates[:HIDDEN], gates[HIDDEN:], u[2 * HIDDEN :]
            n = r * un
            n += g[2 * HIDDEN :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if not mask[t].all():
                new = np.where(mask[t], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, un))
            out[t] = new
            h = out[t]
        return out

    def forward(self, x: np.ndarray, rows: np.ndarray, keep: dict[str, list] | None = None) -> tuple:
        """Logits of the windows and what they come from. x: input vectors, the last for no word; rows: windows x WINDOW."""
        v = self.values
        rows = np.ascontiguousarray(rows.T)
        mask = rows < len(x) - 1
        states, both = {}, 0
        for d in "fb":
            states[d] = self.run(d, x, rows, mask, keep[d] if keep else None)
            both = both + np.stack([v[f"attend_{d}"], v[f"out_{d}"]]) @ states[d]
        attend, value = np.where(mask, both[:, 0], -30), both[:, 1]
        weight = np.exp(attend - attend.max(axis=0))
        weight /= weight.sum(axis=0)
        return (weight * value).sum(axis=0) + v["out_bias"], rows, mask, states, weight, value

    def logits(self, words: Vocabulary, rows: np.ndarray) -> np.ndarray:
        return self.forward(self.inputs(words), rows)[0]

    def gradients(self, words: Vocabulary, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        v = self.values
        kept, x = {"f": [], "b": []}, self.inputs(words)
        logit, rows, mask, states, weight, value = self.forward(x, rows, kept)
        top = ((sigmoid(logit) - labels) * weights / weights.sum()).astype(F32)
        out = {"out_bias": top.sum(keepdims=True)}
        d_value = (weight * top).astype(F32)
        d_attend = (weight * (value - (weight * value).sum(axis=0)) * top * mask).astype(F32)
        dx = np.zeros_like(x)
        for d in "fb":
            out[f"out_{d}"] = np.einsum("tb,thb->h", d_value, states[d])
            out[f"attend_{d}"] = np.einsum("tb,thb->h", d_attend, states[d])
            d_states = d_value[:, None] * v[f"out_{d}"][None, :, None] + d_attend[:, None] * v[f"attend_{d}"][None, :, None]
            state, d_state = v[f"state_{d}"], np.zeros_like(v[f"state_{d}"])
            d_gates = np.empty((len(rows), rows.shape[1], 3 * HIDDEN), F32)
            dh = np.zeros((HIDDEN, rows.shape[1]), F32)
            for t, h, z, r, n, un in reversed(kept[d]):
                total = d_states[t] + dh
                new = total * mask[t]
                dn = new * (1 - z) * (1 - n * n)
                dg = np.concatenate([new * (h - n) * z * (1 - z), dn * un * r * (1 - r), dn])
                du = np.concatenate([dg[: 2 * HIDDEN], dn * r])
                d_state += h @ du.T
                dh = total - new + new * z + state @ du
                d_gates[t] = dg.T
            order = np.argsort(rows, axis=None, kind="stable")
            used, first = np.unique(rows.reshape(-1)[order], return_index=True)
            d_projected = np.add.reduceat(d_gates.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
            d_projected[used == len(x) - 1] = 0  # no word
            out[f"state_{d}"], out[f"in_{d}"], out[f"bias_{d}"] = d_state, x[used].T @ d_projected, d_projected.sum(axis=0)
            dx[used] += d_projected @ v[f"in_{d}"].T
        out["word"], out["piece"] = np.zeros_like(v["word"]), np.zeros_like(v["piece"])
        np.add.at(out["word"], words.slots, dx[:-1, :WORD])
        size = np.diff(words.bounds)
        np.add.at(out["piece"], words.pieces, np.repeat(dx[:-1, WORD:] / size[:, None], size, axis=0))
        out["word"][-1] = out["piece"][-1] = 0  # what was not in the sample has no vector
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """A score per text."""
        words = words_of(column, LETTER_LOWER)
        data, _ = text_bytes(column)
        known = Vocabulary(LETTER_LOWER[data], words, self.word_keys, self.piece_keys)
        places, first = window_rows(words.offsets)
        x = self.inputs(known)
        logits = np.concatenate([self.forward(x, known.rows(places[i : i + CHUNK]))[0] for i in range(0, len(places), CHUNK)])
        top = np.maximum.reduceat(logits, first[:-1])
        return sigmoid(self.slope * top + self.shift).astype(float)


def keys_of_several(data: np.ndarray, words: Words, text_of: np.ndarray, texts: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words and pieces that occur in ``texts`` texts or more. text_of: of each word, ascending; counted by some texts at a time."""
    found: list[list[np.ndarray]] = [[], []]
    counts: list[list[np.ndarray]] = [[], []]
    starts = np.flatnonzero(np.diff(text_of, prepend=-1))[::KEY_STEP]
    for a, b in zip(starts, [*starts[1:], len(text_of)], strict=True):
        pieces, bounds = pieces_of(data, words.starts[a:b], words.ends[a:b])
        for k, (values, owner) in enumerate(((words.hashes[a:b], text_of[a:b]), (pieces, np.repeat(text_of[a:b], np.diff(bounds))))):
            order = np.lexsort((owner, values))
            values, owner = values[order], owner[order]
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            values, n = np.unique(values[new], return_counts=True)
            found[k].append(values)
            counts[k].append(n)
    out = []
    for values, n in zip(found, counts, strict=True):
        keys, at = np.unique(np.concatenate(values) if values else np.zeros(0, np.uint64), return_inverse=True)
        total = np.bincount(at, np.concatenate(n), len(keys)) if values else np.zeros(0)
        out.append(keys[total >= texts])
    return out[0], out[1]


def train(column: pa.Array, text_of: np.ndarray, labels: np.ndarray, epochs: int = 8, steps: int = 1500, seed: int = 11) -> Network:
    """column: window texts; text_of: the text of each (0, 1, ...); labels by text.

    Words and pieces that occur in few texts of the sample have no vector of their own. A small sample is read more often
    than ``epochs`` times, until there are ``steps`` steps.
    """
    epochs = max(epochs, -(-steps * BATCH // max(1, len(column))))
    start = epochs * 3 // 8
    rng = np.random.default_rng(seed)
    data, _ = text_bytes(column)
    data = LETTER_LOWER[data]
    words = words_of(column, LETTER_LOWER)
    owner = text_of[words.document()]
    network = Network.new(seed, *keys_of_several(data, words, owner, max(KEY_TEXTS, KEY_SHARE * len(labels))))
    known = Vocabulary(data, words, network.word_keys, network.piece_keys)
    places, first = window_rows(words.offsets)
    first_of = first[:-1]
    rows = known.rows(places[first_of])
    held = rng.random(len(labels)) < (0.2 if min((labels == c).sum() for c in (0, 1)) >= 8 * KEPT_BACK else 0)
    m = {k: np.zeros_like(v) for k, v in network.values.items()}
    s = {k: np.zeros_like(v) for k, v in network.values.items()}
    step = 0
    for epoch in range(epochs):
        use = np.flatnonzero(~held[text_of])
        if epoch >= start:  # all windows of the clean texts, and of a toxic text the one that looks most toxic
            logit = np.concatenate([network.logits(*part(known, rows[i : i + CHUNK])) for i in range(0, len(rows), CHUNK)])
            order = np.lexsort((-logit, text_of))
            best = np.zeros(len(rows), bool)
            best[order[np.concatenate([[True], text_of[order][1:] != text_of[order][:-1]])]] = True
            use = use[best[use] | (labels[text_of[use]] == 0)]
        toxic = labels[text_of] == 1
        weight = np.where(toxic, 0.5 / max(1, toxic[use].sum()), 0.5 / max(1, (~toxic[use]).sum()))
        rate = 0.02 * 0.1 ** (epoch / max(1, epochs - 1))
        for at in np.array_split(rng.permutation(use), max(1, len(use) // BATCH)):
            local, local_rows = part(known, rows[at])
            grads = network.gradients(local, local_rows, labels[text_of[at]].astype(F32), weight[at])
            step += 1
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                if k in ("word", "piece"):
                    network.values[k] *= F32(1 - rate * DECAY)
                network.values[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(F32)
    logit = np.concatenate([network.logits(*part(known, rows[i : i + CHUNK])) for i in range(0, len(rows), CHUNK)])
    top = np.full(len(labels), -np.inf)
    np.maximum.at(top, text_of, logit)
    some = held if min((labels[held] == c).sum() for c in (0, 1)) >= KEPT_BACK else np.ones(len(labels), bool)
    network.slope, network.shift = calibrated(top[some], labels[some])
    return network


def part(known: Vocabulary, rows: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The distinct words of some windows only."""
    used, local = np.unique(rows, return_inverse=True)
    used = used[used < len(known.slots)]
    out = object.__new__(Vocabulary)
    out.slots = known.slots[used]
    size = np.diff(known.bounds)[used]
    out.bounds = np.concatenate([[0], np.cumsum(size)])
    out.pieces = known.pieces[np.repeat(known.bounds[:-1][used] - out.bounds[:-1], size) + np.arange(out.bounds[-1])]
    return out, local.reshape(rows.shape)


def calibrated(logit: np.ndarray, labels: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and shift of a logistic curve, both labels of equal weight."""
    if len(set(labels)) < 2:
        return 1.0, 0.0
    scale = max(1.0, float(np.abs(logit).max()))
    x = np.stack([logit / scale, np.ones_like(logit)], axis=1)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ ((p - labels) * weight) / len(labels) + ridge * w * [1, 0]
        h = (x * (p * (1 - p) * weight)[:, None]).T @ x / len(labels) + ridge * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", steps: int = 1500) -> Network | None:
    """A network from a bounded sample of the labelled documents; None if a label value is missing."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    chosen = bounded(known, "toxic", TRAIN_TEXTS, "doc_id")  # about twice TRAIN_TEXTS ids: small enough for every task
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            data, bounds = text_bytes(batch.column("text"))
            words = words_of(batch.column("text"), LETTER_LOWER)
            places, first = window_rows(words.offsets)
            keep = np.concatenate([np.linspace(a, b - 1, min(TRAIN_WINDOWS, b - a)).astype(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)])
            owner = np.searchsorted(first, keep, "right") - 1
            texts = []
            for p in places[keep]:
                p = p[p >= 0]
                texts.append(data[words.starts[p[0]] : words.ends[p[-1]]].tobytes().decode() if len(p) else "")
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(owner)), batch.column("toxic").take(pa.array(owner)), pa.array(texts, pa.string())], names=["key", "toxic", "window"])

    cuts = rows.select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text").mapInArrow(cut, "key long, toxic int, window string")
    sample = cuts.toPandas().sort_values(["key", "toxic", "window"])
    if sample["toxic"].nunique() < 2:
        return None
    keys, text_of = np.unique(sample["key"].to_numpy(), return_inverse=True)
    by_text = np.zeros(len(keys), np.int64)
    np.maximum.at(by_text, text_of, sample["toxic"].to_numpy())
    return train(pa.array(sample["window"].tolist(), pa.string()), text_of, by_text, steps=steps)


def score(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text", *extra: Column) -> DataFrame:
    """A row per document: doc_id, ``extra`` columns, score (0 to 1, higher: toxic), predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in blocks(batches, "_text"):
            got = network.scores(batch.column("_text")) if network else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *extra, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{schema}, score double, predicted int")
