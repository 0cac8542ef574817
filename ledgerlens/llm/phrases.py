"""Collocations: phrases of two or three words that are far more frequent than their parts suggest, per language.

Phrases are counted in HAT-tries: a shallow trie over word ids whose leaves are hash containers. A container holds all phrases below
its first word; one that grows beyond ``BURST`` entries is burst into containers by the second word. A task holds at most about ``ENTRIES``
entries; beyond that its largest subtrees leave whole, as sorted runs (first word, the words behind it, counts). Runs are shuffled by their
prefix and merged there by adding up counts. Prefixes of words that make up a thousandth of the corpus or more (at most a thousand words)
are cut into ``SLICES`` by what follows, so that no word's subtree is one task's work.

Words are counted first, then pairs, then triples. A phrase can only be frequent if its parts are: pairs are counted of frequent words, triples
of frequent pairs. What is frequent goes to the tasks as a bit table of bounded size; a bit that is set by chance costs time,
not exactness, because counts below the limit are dropped after merging. Words are known by 64 bits made of word and language; if two words of the
corpus had the same bits, another seed is taken.

Scores are whole numbers from exact decimal arithmetic.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count as often as they occur; an empty table gives an empty result;
phrases end at the end of a text. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import blocks, byte_table, hash_spans, lists, mix, spans_of, text_bytes, written
from ledgerlens.skew import top_per_key

#: Entries of a container before it is burst, entries of a task's trie before subtrees leave, words a task numbers.
BURST, ENTRIES, NUMBERED = 4096, 1 << 20, 1 << 21
#: Share of all words from which a word's prefix is cut, and into how many parts.
HEAVY, SLICES = 1000, 64
#: Bits of the largest bit table.
MOST_BITS = 1 << 26

#: Pieces end at these characters; words of a piece stand between spaces and tabs.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_WORDS = byte_table([(ord(c), ord(c)) for c in PIECE_ENDS + " \t"], lower=True)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in PIECE_ENDS]] = True
_SEED, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_in(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a batch (lang, text): numbers made of word and language, whether the next word continues the piece, starts, ends, rows."""
    data, bounds = text_bytes(batch.column("text"))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))
    starts, ends = spans_of(_WORDS[data] != 0, bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    piece = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
    on = np.zeros(len(starts), bool)
    on[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    langs, at = text_bytes(batch.column("lang"))
    langs = mix(hash_spans(langs, at[:-1], at[1:]) + np.uint64(seed) * _SEED) if len(langs) else np.zeros(len(row), np.uint64)
    return mix(hash_spans(_WORDS[data], starts, ends) ^ langs[row]), on, starts, ends, row


class HatTrie:
    """Counts by first key and rest. ``deep``: a rest is two word ids of 32 bits, of which the first can become a level of the trie."""

    def __init__(self, deep: bool, burst: int = BURST):
        self.deep, self.burst = deep, burst
        self.root: dict[int, Counter | dict[int, Counter]] = {}
        self.most = 0  # an upper bound of the entries

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Counts an occurrence of each (first, rest)."""
        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        values = rest.tolist()
        for key, a, b in zip(first[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True):
            node = self.root.get(key)
            if node is None:
                node = self.root[key] = Counter()
            if isinstance(node, Counter):
                node.update(values[a:b])
                if self.deep and len(node) > self.burst:
                    self.root[key] = self.burst_into(node)
            else:
                second = rest[a:b] >> 32
                inner = np.flatnonzero(np.diff(second)) + 1
                third = (rest[a:b] & 0xFFFFFFFF).tolist()
                for s, i, j in zip(second[np.append(0, inner)].tolist(), [0, *inner.tolist()], [*inner.tolist(), b - a], strict=True):
                    node.setdefault(s, Counter()).update(third[i:j])
        self.most += len(first)

    @staticmethod
    def burst_into(container: Counter) -> dict[int, Counter]:
        children: dict[int, Counter] = {}
        for rest, n in container.items():
            children.setdefault(rest >> 32, Counter())[rest & 0xFFFFFFFF] = n
        return children

    @staticmethod
    def size(node) -> int:
        return len(node) if isinstance(node, Counter) else sum(map(len, node.values()))

    def leave(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes whole subtrees out, the largest first, until at most ``keep`` entries are left: first keys, rests, counts."""
        sizes = {key: self.size(node) for key, node in self.root.items()}
        self.most = sum(sizes.values())
        gone = []
        for key in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.most <= keep:
                break
            gone.append((key, self.root.pop(key)))
            self.most -= sizes[key]
        rests, counts, per = [], [], []
        for _, node in gone:
            parts = [(0, node)] if isinstance(node, Counter) else [(s << 32, c) for s, c in node.items()]
            for high, c in parts:
                rests.append(np.fromiter(c.keys(), np.int64, len(c)) + high)
                counts.append(np.fromiter(c.values(), np.int64, len(c)))
            per.append(sum(len(c) for _, c in parts))
        none = np.zeros(0, np.int64)
        return np.repeat(np.array([k for k, _ in gone], np.int64), per), np.concatenate([none, *rests]), np.concatenate([none, *counts])


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """w (64 bits), lang, word, n: all words, merged."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        texts: dict[int, tuple[bytes, str]] = {}

        def run() -> pa.RecordBatch:
            keys = sorted(known)
            columns = [pa.array(keys, pa.int64()), pa.array([texts[k][1] for k in keys], pa.string()), pa.array([texts[k][0] for k in keys], pa.binary()),
                       pa.array([known[k] for k in keys], pa.int64())]
            known.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["w", "lang", "word", "n"])

        for batch in blocks(batches, "text"):
            words, _, starts, ends, row = words_in(batch, seed)
            found, first, counts = np.unique(words.view(np.int64), return_index=True, return_counts=True)
            data = _PLAIN[text_bytes(batch.column("text"))[0]].tobytes()
            langs = batch.column("lang").to_pylist()
            for key, n, a, b, r in zip(found.tolist(), counts.tolist(), starts[first].tolist(), ends[first].tolist(), row[first].tolist(), strict=True):
                known[key] += n
                if key not in texts:
                    texts[key] = (data[a:b], langs[r])
            if len(known) > ENTRIES // 2:
                yield run()
        if known:
            yield run()

    runs = docs.mapInArrow(scan, "w long, lang string, word binary, n long")
    return runs.repartition("w").groupBy("w", "lang", "word").agg(F.sum("n").alias("n"))


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """Which slots of a table the keys (64 bits) take: about sixteen slots per key, ``MOST_BITS`` at most, as 64-bit words."""
    bits = 1 << max(12, min(MOST_BITS.bit_length() - 1, (16 * keys.count()).bit_length()))
    slot = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _NEXT + second)


def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w1, w2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2"))
        yield pa.RecordBatch.from_arrays([pa.array(pair_key(w1, w2).view(np.int64))], names=["key"])


def phrase_counts(docs: DataFrame, size: int, seed: int, table: np.ndarray, heavy: np.ndarray, least: int) -> DataFrame:
    """w1, w2 (, w3), n of phrases of ``size`` words that occur ``least`` times. table: frequent words (2) or pairs (3); heavy: words with cut prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast((table, np.sort(heavy)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, heavy = shared.value
        trie, ids = HatTrie(size == 3), {}
        names: list[int] = []

        def run(keep: int) -> pa.RecordBatch:
            first, rest, counts = trie.leave(keep)
            name = np.array(names, np.uint64)
            w1 = name[first]
            w2, w3 = (name[rest >> 32], name[rest & 0xFFFFFFFF]) if size == 3 else (name[rest], np.zeros(len(rest), np.uint64))
            cut = heavy[np.minimum(np.searchsorted(heavy, w1), len(heavy) - 1)] == w1 if len(heavy) else np.zeros(len(w1), bool)
            slice_ = np.where(cut, (pair_key(w2, w3) % np.uint64(SLICES)).astype(np.int64), 0)
            order = np.lexsort((w3, w2, slice_, w1))
            w1, w2, w3, slice_, counts = (x[order] for x in (w1, w2, w3, slice_, counts))
            head = np.flatnonzero(np.append(True, (np.diff(w1) != 0) | (np.diff(slice_) != 0))) if len(w1) else np.zeros(0, np.int64)
            offsets = np.append(head, len(w1))
            behind = [lists(x.view(np.int64), offsets, pa.int64()) for x in ((w2, w3) if size == 3 else (w2,))]
            return pa.RecordBatch.from_arrays(
                [pa.array(w1[head].view(np.int64)), pa.array(slice_[head].astype(np.int32)), *behind, lists(counts, offsets, pa.int64())],
                names=["w1", "slice", *(["w2", "w3"] if size == 3 else ["w2"]), "n"])

        for batch in blocks(batches, "text"):
            words, on, *_ = words_in(batch, seed)
            if size == 2:
                good = in_table(table, words)
                at = np.flatnonzero(on[:-1] & good[:-1] & good[1:]) if len(words) else np.zeros(0, np.int64)
            else:
                good = np.zeros(len(words), bool)
                good[:-1] = on[:-1]
                some = np.flatnonzero(good)
                good[some] = in_table(table, pair_key(words[some], words[some + 1]))
                at = np.flatnonzero(good[:-2] & good[1:-1]) if len(words) > 2 else np.zeros(0, np.int64)
            used, place = np.unique(np.concatenate([words[at + k] for k in range(size)]), return_inverse=True)
            for w in used.tolist():
                if w not in ids:
                    ids[w] = len(names)
                    names.append(w)
            number = np.array([ids[w] for w in used.tolist()], np.int64)[place].reshape(size, -1) if len(used) else np.zeros((size, 0), np.int64)
            trie.add(number[0], number[1] if size == 2 else number[1] << 32 | number[2])
            if trie.most > ENTRIES:
                trie.most = sum(map(trie.size, trie.root.values()))
            if len(names) > NUMBERED or trie.most > ENTRIES:
                yield run(0 if len(names) > NUMBERED else ENTRIES // 2)
                if not trie.root:
                    ids.clear()
                    names.clear()
        yield run(0)

    behind = ["w2", "w3"][: size - 1]
    kinds = "".join(f", {c} array<long>" for c in behind)
    runs = docs.mapInArrow(scan, f"w1 long, slice int{kinds}, n array<long>").repartition("w1", "slice")
    rows = runs.select("w1", "slice", F.explode(F.arrays_zip(*behind, "n")).alias("r")).select("w1", "slice", "r.*")
    return rows.groupBy("w1", "slice", *behind).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("w1", *behind, "n")


def cut_score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), exact."""
    whole = lambda c, digits: f"cast({c} as decimal({digits}, 0))"
    return F.expr(f"(1000000 * {whole(a, 15)} * {whole(a, 15)}) div ({whole(left, 18)} * {whole(right, 18)})")


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, longest: int = 3, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` (2 or 3) words.

    Phrases occur ``least`` times; one that lies in a longer candidate with at least ``percent`` % of its occurrences is dropped.
    """
    assert longest in (2, 3)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    seed = 0
    while True:
        words = written(word_counts(docs, seed), "words")
        same = words.groupBy("w").agg(F.count("*").alias("words"), F.max("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if not same.limit(1).count():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least).select("w", "lang", F.col("word").cast("string").alias("word"), F.col("n").alias("f"))
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    heavy = frequent.where(F.col("f") * HEAVY >= all_words).select("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64)  # at most HEAVY rows

    pairs = phrase_counts(docs, 2, seed, bit_table(frequent, "w"), heavy, least)
    first, second = (frequent.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else [])) for i in (1, 2))
    pairs = written(pairs.join(first, "w1").join(second, "w2").select("lang", "w1", "w2", "t1", "t2", "f1", "f2", F.col("n").alias("a")), "pairs")
    scored = pairs.select("lang", "w1", "w2", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    scored = scored.withColumn("score", cut_score("a", "l", "r"))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    if longest == 3:
        keyed = pairs.select("w1", "w2").mapInArrow(pair_keys, "key long")
        triples = phrase_counts(docs, 3, seed, bit_table(keyed, "key"), heavy, least)
        head = pairs.select("lang", "w1", "w2", "t1", "t2", "f1", F.col("a").alias("f12"))
        tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("t2").alias("t3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
        triples = triples.withColumnRenamed("n", "a").join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
        triples = written(triples.withColumns({"s1": cut_score("a", "f1", "f23"), "s2": cut_score("a", "f12", "f3")}), "triples")
        early = F.col("s1") <= F.col("s2")
        longer = triples.select(
            "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
        inside = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("inside"))
        scored = scored.join(inside, ["w1", "w2"], "left").where(100 * F.coalesce("inside", F.lit(0)) < percent * F.col("a"))
        scored = scored.select(columns).union(longer.select(columns))
    best = top_per_key(scored.select(columns), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
