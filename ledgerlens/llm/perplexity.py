"""Quality rules: text statistics, and perplexity under modified Kneser-Ney models of byte n-grams, one per language.

Spark counts the n-grams of all texts (tasks add up their own first, so a frequent one is a row per task, not per occurrence), and joins on
n-gram, context and suffix turn the counts into interpolated probabilities with three discounts per order and language. Every n-gram
of the corpus is in the model, so scoring needs its highest order only: arrays of hashes, sorted, with the log-probabilities beside them. A
table of the hashes' leading bits tells where to look. The arrays are sent to the tasks in shards of a fixed size; a model of several shards
takes as many passes, each of which adds what its shard knows, so the size of the model is not bounded by a task's memory.

A text's own grams would make it look usual to a model that has them, so texts are dealt into two folds by a hash (copies fall together), and each
is judged by the model of the other fold: the same tables hold the counts of all texts and of either fold, and what a fold has not seen gets its
probability from shorter contexts.

A document is rejected if this left-out log-perplexity lies outside its language's band: the median plus and minus ``SPREADS`` times the scaled median
deviation (and at least ``LEAST`` nats) over the language's documents that pass the base rules.

Defined cases: null texts are empty; empty and wordless texts have no perplexity and fail by their word count; a null language is a language of its
own. Repeated rows and ids give a row each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import SPACE_EXACT, blocks, grams, hash_spans, mix, text_bytes, words_of, written

ORDER = 5
#: Entries of the model that a task holds at once; distinct n-grams that a task adds up before it passes them on.
SHARD, HELD = 3_000_000, 2_000_000
SPREADS, LEAST = 6.0, 0.1
#: Base rules: words at least, and the largest share of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT = 50, 0.5
SYMBOLS = b"#*$%&|<>"
NO_LANGUAGE = ""
#: Counts of all texts, and of the texts of either fold: a model each.
MODELS = ("n", "n0", "n1")


def fold(text: str) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(text), F.lit(2))


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64)
    out[65:91] += np.uint64(32)
    out[48:58] = 48
    out[9:14] = 32
    return out


FOLDED = _table()


def byte_grams(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """For each byte the bytes up to it, as one number; texts are preceded by spaces."""
    size = np.diff(bounds)
    text = np.full(len(data) + (order - 1) * len(size), 32, np.uint64)
    at = np.arange(len(data)) + np.repeat((np.arange(len(size)) + 1) * (order - 1), size)
    text[at] = FOLDED[data]
    out = text[at]
    for j in range(1, order):
        out |= text[at - j] << np.uint64(8 * j)
    return out


def text_figures(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, bounds = text_bytes(column)
    words = words_of(column, SPACE_EXACT)
    docs = len(bounds) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(flags)])
        return seen[bounds[1:]] - seen[bounds[:-1]]

    # Lines end at line feeds and at the text's end.
    feed = np.flatnonzero(data == 10)
    starts, ends = np.concatenate([bounds[:-1], feed + 1]), np.concatenate([feed, bounds[1:]])
    starts.sort()
    ends.sort()
    owner = np.searchsorted(bounds, starts, "right") - 1
    # An empty text's only line, and the line after a text's last feed, have no word.
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[worded], ends[worded], owner[worded]
    key = mix(hash_spans(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(owner[order][again], minlength=docs)

    values, at = grams(words, 3)
    key = mix(values + words.document()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(words.hashes) + 2, bool)
    for j in range(3):
        hit[at[twice] + j] = True
    seen = np.concatenate([[0], np.cumsum(hit)])
    inside = SPACE_EXACT[data] != 0
    return {
        "n_words": np.diff(words.offsets), "word_chars": per_text(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))), "n_dup_lines": dup_lines,
        "n_repeat_words": seen[words.offsets[1:]] - seen[words.offsets[:-1]],
    }


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(docs: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """lang, gram, n over all texts, n0 and n1 over those of each fold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, n = summed(keys, counts)
            known = pa.array(list(names), pa.string())
            return pa.RecordBatch.from_arrays([
                known.take(pa.array((k >> np.uint64(8 * order)).astype(np.int64))), pa.array((k & np.uint64((1 << 8 * order) - 1)).view(np.int64)),
                pa.array(n & 0xFFFFFFFF), pa.array(n >> 32)], names=["lang", "gram", "n0", "n1"])

        for batch in blocks(batches, "text"):
            code = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.uint64)
            data, bounds = text_bytes(batch.column("text"))
            found = byte_grams(data, bounds, order) | np.repeat(code, np.diff(bounds)) << np.uint64(8 * order)
            second = np.repeat(batch.column("fold").to_numpy() == 1, np.diff(bounds))
            # Both folds' counts in one number, so that they are added up together.
            for of, shift in ((~second, 0), (second, 32)):
                k, n = np.unique(found[of], return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int64) << shift)
                held += len(k)
            if held > HELD:
                k, n = summed(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > HELD // 2:
                    yield out()
                    keys, counts, held = [], [], 0
        if keys:
            yield out()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"), fold(text).alias("fold")).where("text is not null")
    found = rows.mapInArrow(scan, "lang string, gram long, n0 long, n1 long").groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return found.withColumn("n", F.col("n0") + F.col("n1"))


def suffix(order: int) -> Column:
    """The last ``order`` bytes of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """lang, gram, and of each of ``MODELS`` p_...: interpolated modified Kneser-Ney probabilities of the highest order.

    Lower orders count the different bytes that stand before a gram. Where counts of counts don't give a discount it is 0.5. A gram that a model
    has not seen gets what its context leaves to shorter ones; an unseen context leaves everything.
    """
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        seen = [F.count(F.when(F.col(m) > 0, 1)).alias(m) for m in MODELS]
        tables[n] = written(tables[n + 1].groupBy("lang", suffix(n).alias("gram")).agg(*seen), f"grams-{n}")
    of = lambda m, k: F.count(F.when(F.col(m) == k, 1))

    def discount(m: str, k: int) -> Column:
        y = F.col(f"{m}_1") / (F.col(f"{m}_1") + 2 * F.col(f"{m}_2"))
        here, next_ = F.col(f"{m}_{k}"), F.col(f"{m}_{k + 1}")
        found = F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * next_ / here))
        return F.coalesce(F.when((here > 0) & (next_ > 0), found), F.lit(0.5))

    def own(m: str) -> Column:
        taken = F.when(F.col(m) == 1, F.col(f"{m}_d1")).when(F.col(m) == 2, F.col(f"{m}_d2")).otherwise(F.col(f"{m}_d3"))
        return F.when(F.col(m) > 0, (F.col(m) - taken) / F.col(f"{m}_total")).otherwise(0.0)

    def spare(m: str) -> Column:
        c1, c2, c, total = (F.col(f"{m}_{x}") for x in ("c1", "c2", "c", "total"))
        return F.when(total > 0, (F.col(f"{m}_d1") * c1 + F.col(f"{m}_d2") * c2 + F.col(f"{m}_d3") * (c - c1 - c2)) / total).otherwise(1.0)

    lower = None
    for n in range(1, order + 1):
        grams_ = tables[n].withColumn("context", F.shiftright("gram", 8))
        d = grams_.groupBy("lang").agg(*[of(m, k).alias(f"{m}_{k}") for m in MODELS for k in (1, 2, 3, 4)])
        d = d.select(F.col("lang"), *[discount(m, k).alias(f"{m}_d{k}") for m in MODELS for k in (1, 2, 3)])
        contexts = grams_.groupBy("lang", "context").agg(*[x for m in MODELS for x in (
            F.sum(m).alias(f"{m}_total"), of(m, 1).alias(f"{m}_c1"), of(m, 2).alias(f"{m}_c2"), F.count(F.when(F.col(m) > 0, 1)).alias(f"{m}_c"))])
        # The languages are few; the join with the discounts is left to the optimizer.
        rows = grams_.join(contexts, ["lang", "context"]).join(d, "lang").select(
            "lang", "gram", *[x for m in MODELS for x in (own(m).alias(f"own_{m}"), spare(m).alias(f"spare_{m}"))])
        if lower is None:
            lower = rows.select("lang", "gram", *[(F.col(f"own_{m}") + F.col(f"spare_{m}") / 256).alias(f"p_{m}") for m in MODELS])
        else:
            below = lower.select("lang", F.col("gram").alias("_suffix"), *[F.col(f"p_{m}").alias(f"_p_{m}") for m in MODELS])
            rows = rows.withColumn("_suffix", suffix(n - 1)).join(below, ["lang", "_suffix"])
            lower = rows.select("lang", "gram", *[(F.col(f"own_{m}") + F.col(f"spare_{m}") * F.col(f"_p_{m}")).alias(f"p_{m}") for m in MODELS])
        lower = written(lower, f"probabilities-{n}")
    return lower


class HashArrays:
    """Sorted hashes with a row of values each, found by their leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        # The last hash never matches, so that a search may run past the end.
        self.hashes = np.append(hashes[order], np.uint64(0))
        self.values = np.concatenate([values[order].astype(np.float32), np.zeros((1, values.shape[1]), np.float32)])
        self.bits = max(1, int(2 * len(hashes)).bit_length())
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The rows in ``values``; what is not there has the last row, of zeros."""
        at = self.first[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        found = self.hashes[at]
        out = np.where(found == wanted, at, len(self.hashes) - 1)
        todo = np.flatnonzero((found < wanted) & (at < len(self.hashes) - 1))
        at = at[todo] + 1
        while len(todo):
            found = self.hashes[at]
            same = found == wanted[todo]
            out[todo[same]] = at[same]
            on = (found < wanted[todo]) & (at < len(self.hashes) - 1)
            todo, at = todo[on], at[on] + 1
        return out


def measured(docs: DataFrame, model: DataFrame, doc_id: str, text: str, lang: str, order: int) -> DataFrame:
    """doc_id, lang, the text figures, n_bytes, log_p and left_p (by the other fold's model) of each document."""
    shards = max(1, -(-model.count() // SHARD))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "lang", F.xxhash64("lang").alias("salt"), fold("text").alias("fold"), "text", F.lit(0.0).alias("log_p"), F.lit(0.0).alias("left_p"))
    kind = dict(rows.dtypes)["doc_id"]
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes"]
    for shard in range(shards):
        part = model.where(F.pmod(F.xxhash64("gram", "lang"), F.lit(shards)) == shard)
        logs = [F.log(f"p_{m}").cast("float").alias(m) for m in MODELS]
        part = part.select(F.col("gram").bitwiseXOR(F.xxhash64("lang")).alias("key"), *logs).toArrow()  # at most about SHARD rows of 20 bytes
        arrays = HashArrays(mix(part["key"].to_numpy().view(np.uint64)), np.stack([part[m].to_numpy() for m in MODELS], axis=1))
        del part
        shared = docs.sparkSession.sparkContext.broadcast(arrays)
        last = shard == shards - 1

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in blocks(batches, "text"):
                data, bounds = text_bytes(batch.column("text"))
                salts = batch.column("salt").to_numpy().view(np.uint64)
                at = known.find(mix(byte_grams(data, bounds, order) ^ np.repeat(salts, np.diff(bounds)))) if len(data) else np.zeros(0, np.int64)
                # The texts of fold 0 are judged by n1, those of fold 1 by n0.
                other = np.repeat(2 - batch.column("fold").to_numpy(), np.diff(bounds))
                sums = []
                for name, values in (("log_p", known.values[at, 0]), ("left_p", known.values[at, other])):
                    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                    sums.append(pa.array(batch.column(name).to_numpy() + total[bounds[1:]] - total[bounds[:-1]]))
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:5], *sums], names=batch.schema.names)
                    continue
                got = text_figures(batch.column("text")) | {"n_bytes": np.diff(bounds)}
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], *[pa.array(got[f].astype(np.int64)) for f in figures], *sums], names=["doc_id", "lang", "salt", "fold", *figures, "log_p", "left_p"])

        schema = f"doc_id {kind}, lang string, salt long, fold long, " + (", ".join(f"{f} long" for f in figures) if last else "text string") + ", log_p double, left_p double"
        rows = rows.mapInArrow(scan, schema)
        rows = written(rows, "measured")
    return rows


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, spreads: float = SPREADS, least: float = LEAST,
) -> DataFrame:
    """A row per document: doc_id, lang, figures, log_perplexity (model of all texts), left_out (of the other fold), low and high (its band), base_failed, kept."""
    counts = written(gram_counts(docs, text, lang, order), "grams")
    rows = measured(docs, kneser_ney(counts, order), doc_id, text, lang, order)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("log_perplexity", F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes")))
    rows = rows.withColumn("left_out", F.when(F.col("n_bytes") > 0, -F.col("left_p") / F.col("n_bytes")))
    good = rows.where(~F.col("base_failed"))
    middle = good.groupBy("lang").agg(F.percentile_approx("left_out", 0.5, 10000).alias("middle"))
    spread = good.join(middle, "lang").groupBy("lang", "middle").agg(
        F.percentile_approx(F.abs(F.col("left_out") - F.col("middle")), 0.5, 10000).alias("spread"))
    width = F.greatest(F.lit(least), F.lit(spreads * 1.4826) * F.col("spread"))
    bands = spread.select("lang", (F.col("middle") - width).alias("low"), (F.col("middle") + width).alias("high"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("left_out").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.join(bands, "lang", "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "left_out", "low", "high", "base_failed", kept.alias("kept"))
