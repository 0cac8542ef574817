"""Language identification by a convolutional network over bytes.

Filters of several widths run over the bytes of fixed-length windows; the largest response of each filter in a window goes to a softmax
over the languages. The network is trained in numpy on a bounded sample of labelled texts and applied to all windows of whole texts;
a text's distribution is the mean of its windows' log-probabilities, normalised. Since the first layer sees one byte per place, a filter is
a sum of table entries; scoring merges the tables of neighbouring bytes into tables of byte pairs, which gives the same sums.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no labelled rows every text is. Ties go to the
language that sorts first. Rows are independent, so repeated rows and ids give a row each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.samples import bounded
from ledgerlens.llm.words import blocks, text_bytes

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 8
#: Bounds of the training sample: texts per language, and windows of a text.
TRAIN_TEXTS, TRAIN_WINDOWS = 600, 4
UNKNOWN = "und"


def _table() -> np.ndarray:
    """Letters lowered, bytes above ASCII kept, all else a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = out[65:91] = np.arange(97, 123)
    return out


TABLE = _table()


@dataclass
class ByteCnn:
    languages: list[str]
    filters: list[np.ndarray]  # per width: width x 256 x filters
    bias: np.ndarray
    dense: np.ndarray  # features x languages
    dense_bias: np.ndarray
    pairs: list[list[np.ndarray]] | None = None

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Per width the tables of its first, third, ... two bytes."""
        if self.pairs is None:
            self.pairs = [[np.ascontiguousarray((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, len(t) - 1, 2)] for t in self.filters]
        return self.pairs

    def features(self, windows: np.ndarray) -> np.ndarray:
        """windows: n x WINDOW bytes."""
        n, length = windows.shape
        flat = np.ascontiguousarray(windows).reshape(-1)
        pairs = np.full(len(flat) + 2, 0, np.intp)
        pairs[: len(flat) - 1] = flat[:-1].astype(np.intp) << 8 | flat[1:]
        single = np.concatenate([flat, np.zeros(2, np.uint8)]).astype(np.intp)
        out, got, part = [], None, None
        for width, tables, merged in zip(WIDTHS, self.filters, self.pair_tables(), strict=True):
            got = np.take(merged[0], pairs[: len(flat)], axis=0, out=got, mode="clip")
            for k, table in enumerate(merged[1:], 1):
                part = np.take(table, pairs[2 * k : len(flat) + 2 * k], axis=0, out=part, mode="clip")
                got += part
            if width % 2:
                part = np.take(tables[width - 1], single[width - 1 : len(flat) + width - 1], axis=0, out=part, mode="clip")
                got += part
            # Places from which a filter would leave its window don't count.
            out.append(got.reshape(n, length, -1)[:, : length - width + 1].max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled with spaces, and their bounds by text. An empty text has none."""
    size = np.diff(bounds)
    count = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.full((first[-1], WINDOW), 32, np.uint8).reshape(-1)
    at = np.repeat(first[:-1] * WINDOW - bounds[:-1], size) + np.arange(len(data))
    out[at] = TABLE[data]
    return out.reshape(-1, WINDOW), first


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 7) -> ByteCnn:
    """Cross-entropy by Adam. A filter learns only from the place of its largest response in a window."""
    rng = np.random.default_rng(seed)
    features = FILTERS * len(WIDTHS)
    shapes = [(w, 256, FILTERS) for w in WIDTHS] + [(features,), (features, len(languages)), (len(languages),)]
    values = [rng.normal(0, 0.3, s).astype(np.float32) for s in shapes[: len(WIDTHS)]] + [
        np.zeros(features, np.float32), rng.normal(0, 0.2, shapes[-2]).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    x_all = windows.astype(np.int64)
    for epoch in range(epochs):
        rate = 0.02 * 0.5 ** (epoch / 4)
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 128)):
            x, y = x_all[at], labels[at]
            tops, places = [], []
            for width, tables in zip(WIDTHS, values, strict=False):
                got = sum(tables[j][x[:, j : WINDOW - width + 1 + j]] for j in range(width))
                place = got.argmax(axis=1)
                places.append(place)
                tops.append(np.take_along_axis(got, place[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(tops, axis=1) + values[-3]
            act = np.maximum(raw, 0)
            z = act @ values[-2] + values[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ values[-2].T) * (raw > 0)
            grads = [np.zeros_like(v) for v in values]
            for k, width in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    byte = np.take_along_axis(x, places[k] + j, axis=1)
                    np.add.at(grads[k][j], (byte, np.arange(FILTERS)[None, :]), own)
            grads[-3], grads[-2], grads[-1] = back.sum(axis=0), act.T @ p, p.sum(axis=0)
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(languages, values[: len(WIDTHS)], *values[len(WIDTHS) :])


def fit(texts: DataFrame, text: str, lang: str, doc_id: str) -> ByteCnn | None:
    """A network from a bounded sample of the labelled rows; None without any."""
    rows = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            windows, first = windows_of(*text_bytes(batch.column("text")))
            keep = np.concatenate([[0][:0]] + [np.linspace(a, b - 1, min(TRAIN_WINDOWS, b - a)).astype(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]).astype(np.int64)
            owner = np.searchsorted(first, keep, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(owner)), pa.array([w.tobytes() for w in windows[keep]], pa.binary())], names=["lang", "window"])

    sample = bounded(rows, "lang", TRAIN_TEXTS, "doc_id", "text").mapInArrow(cut, "lang string, window binary").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "window"])
    languages = sorted(sample["lang"].unique())
    windows = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(languages, sample["lang"].to_numpy()), languages)


def identify(docs: DataFrame, model: ByteCnn | None, doc_id: str = "doc_id", text: str = "text", *extra: Column) -> DataFrame:
    """A row per document: doc_id, ``extra`` columns (from doc_id and text), lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks(batches, "_text"):
            data, bounds = text_bytes(batch.column("_text"))
            label, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if model is not None and len(data):
                windows, first = windows_of(data, bounds)
                logs = np.concatenate([model.log_probabilities(windows[i : i + 128]) for i in range(0, len(windows), 128)])
                some = np.flatnonzero(np.diff(first))
                mean = np.add.reduceat(logs, first[:-1][some], axis=0) / np.diff(first)[some, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                label[some], score[some] = p.argmax(axis=1), p.max(axis=1)
                letters = np.concatenate([[0], np.cumsum((TABLE[data] != 32) & (data < 128))])
                for i in np.flatnonzero(letters[bounds[1:]] == letters[bounds[:-1]]):
                    if not any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode()):
                        label[i], score[i] = -1, 0.0
            names = np.array([*(model.languages if model else []), UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[label], pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *extra, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{schema}, lang_pred string, score double")
