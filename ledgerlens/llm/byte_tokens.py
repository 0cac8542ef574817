"""Token ids of whole text columns by a byte-level vocabulary, with a cache of words.

The vocabulary cuts a text into words before it merges bytes, and a space that stands before a letter, digit or mark always begins a
word. So a text's ids are those of its parts between such spaces, each with its space. Parts, their hashes and the places of their ids
come from array passes over a block of texts; only parts that a Python worker has not met yet go to the tokenizer, many at a time. The
cache is bounded and only saves time; a part found there is compared with length, head and tail of the one that was put there.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from ledgerlens.llm.words import hash_spans, text_bytes

#: Parts a worker remembers; beyond it the cache starts anew.
CACHE_PARTS = 1_200_000
#: New parts that are given to the tokenizer as one text.
JOINED = 200

_WORKERS: dict[str, ByteWordIds] = {}
#: Bytes behind a space that surely begins a word: printable ASCII and letters of U+00C0 to U+00FF.
_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = _SURE[0xC3] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def spread(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions at[i], at[i] + 1, ... of ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(at - before, lengths) + np.arange(int(lengths.sum()))


def eight_bytes(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each position as a number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))[at]
    return eight & ((np.uint64(1) << (np.minimum(lengths, 7) * 8).astype(np.uint64)) - np.uint64(1) | np.where(lengths >= 8, ~np.uint64(0), np.uint64(0)))


def facts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length, first and last eight bytes of each part."""
    tail = np.maximum(ends - 8, starts)
    lengths = ends - starts
    return np.stack([lengths.astype(np.uint64), eight_bytes(data, starts, lengths), eight_bytes(data, tail, ends - tail)], axis=1)


class ByteWordIds:
    """Ids of text columns as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("Ġ")  # how the vocabulary writes a space
        self.tails = {ord(c): vocabulary[c] for c in ",."}
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        #: Of each key: place and number of ids in the pool, and length, first and last eight bytes of its part.
        self.facts = np.zeros((0, 5), np.uint64)
        self.pool = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> ByteWordIds:
        """The worker's own instance."""
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Straight from the tokenizer."""
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.frombuffer(array("I", e.ids), np.uint32) if e.ids else np.zeros(0, np.uint32) for e in found]

    def behind_space(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each part with a space before it, one after the other, and their numbers. Parts without another space go through together."""
        out: list[np.ndarray | None] = [None] * len(parts)
        whole = [i for i, p in enumerate(parts) if p and b" " not in p]
        single = [i for i, p in enumerate(parts) if not p or b" " in p]
        groups = [whole[i : i + JOINED] for i in range(0, len(whole), JOINED)]
        for group, ids in zip(groups, self.plain([b" " + b" ".join([parts[i] for i in g]) for g in groups]), strict=True):
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(group) and starts[0] == 0:
                for i, part in zip(group, np.split(ids, starts[1:]), strict=True):
                    out[i] = part
            else:
                single += group
        for i, ids in zip(single, self.plain([b" " + parts[i] for i in single]), strict=True):
            out[i] = ids
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.array([len(x) for x in out], np.int64)

    def places(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct parts lie in the pool, and how many they are. Keys ascend; different parts may share one."""
        if len(self.keys) + len(keys) > CACHE_PARTS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        ids, counts = self.behind_space([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        first = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids])
        added = np.concatenate([first[:, None].astype(np.uint64), counts[:, None].astype(np.uint64), facts[new]], axis=1)
        self.facts = np.insert(self.facts, at[new], added, axis=0)
        self.keys = np.insert(self.keys, at[new], keys[new])
        found = self.facts[np.searchsorted(self.keys, keys)]
        place, number = found[:, 0].astype(np.int64), found[:, 1].astype(np.int64)
        for i in np.flatnonzero((found[:, 2:] != facts).any(axis=1)):  # another part of the same hash
            ids, counts = self.behind_space([raw[starts[i] : ends[i]]])
            place[i], number[i] = len(self.pool), counts[0]
            self.pool = np.concatenate([self.pool, ids])
        return place, number

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their bounds; a null is an empty text."""
        data, bounds = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), bounds
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & _SURE[data[1:]]
        cut[bounds[1:][bounds[1:] > 0] - 1] = False
        raw = data.tobytes()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:  # marks of the vocabulary are ids of their own: such a text goes through whole
                text = int(np.searchsorted(bounds, at, "right"))
                cut[bounds[text - 1] : bounds[text]] = False
                at = raw.find(mark, int(bounds[text]))
        cuts = np.flatnonzero(cut)
        some = bounds[1:] > bounds[:-1]
        starts = np.sort(np.concatenate([bounds[:-1][some], cuts + 1]))
        ends = np.sort(np.concatenate([bounds[1:][some], cuts]))
        head = np.zeros(len(starts), bool)
        head[np.searchsorted(starts, bounds[:-1][some])] = True
        heads, body = np.flatnonzero(head), np.flatnonzero(~head)
        # A comma or full stop behind an ASCII letter is a word of its own.
        last = data[ends[body] - 1]
        tailed = ((last == 0x2C) | (last == 0x2E)) & (ends[body] - starts[body] > 1)
        tailed &= _LETTER[data[np.maximum(ends[body] - 2, 0)]]
        first, to = starts[body], ends[body] - tailed
        hashes, facts = hash_spans(data, first, to), facts_of(data, first, to)
        keys, one, of = np.unique(hashes, return_index=True, return_inverse=True)
        if (facts != facts[one][of]).any():  # parts of one hash
            _, one, of = np.unique(np.concatenate([hashes[:, None], facts], axis=1), axis=0, return_index=True, return_inverse=True)
            keys = hashes[one]
        place, number = self.places(data, keys, first[one], to[one], facts[one])

        found = self.plain([raw[a:b] for a, b in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)])
        lengths = np.zeros(len(starts), np.int64)
        lengths[heads] = [len(x) for x in found]
        lengths[body] = number[of] + tailed
        at = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        out[spread(at[heads], lengths[heads])] = np.concatenate(found)
        out[spread(at[body], number[of])] = self.pool[spread(place[of], number[of])]
        marks = np.zeros(256, np.uint32)
        for byte, i in self.tails.items():
            marks[byte] = i
        out[(at[body] + number[of])[tailed]] = marks[last[tailed]]
        return out, np.append(at, len(out))[np.searchsorted(starts, bounds)]
