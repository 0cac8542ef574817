"""Token ids of whole texts by a public tokenizer file, with a cache of words.

White space never is part of a token of the vocabularies used here, so a text's ids are those of its space-separated parts in order.
Each Python worker keeps the ids of the parts that it has met (a bounded cache that only saves time) and asks the tokenizer for new
ones in batches.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np

#: Parts a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 700_000
#: Bytes of text that are split at once; cuts are at white space.
SEGMENT = 1 << 20
#: New words of letters that are given to the tokenizer as one text.
JOINED = 200

_WORKERS: dict[str, WordIds] = {}
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
_SPACES = b" \t\n\r\x0b\x0c"


class WordIds:
    """Ids of byte texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts without these heads of the vocabulary's marks may be folded to lower case first, which the vocabulary does anyway.
        self.heads = {t.content[:2].lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The worker's own instance."""
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def learn(self, words: set[bytes]) -> None:
        known = self.known
        # A comma or full stop after an ASCII letter is a token of its own: the part without it is looked up.
        tails = [w for w in words if len(w) > 1 and w[-1] in b",." and w[-2] in _LETTERS]
        bare = words.difference(tails)
        bare.update(w[:-1] for w in tails)
        if tails:
            bare.update((b",", b"."))
        bare = bare.difference(known)
        if self.ends.any():
            bare = self.learn_letters([w for w in bare if w.decode().isalpha()], bare)
        bare = list(bare)
        for w, e in zip(bare, self.tokenizer.encode_batch_fast([w.decode() for w in bare], add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        for w in tails:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def learn_letters(self, words: list[bytes], open_: set[bytes]) -> set[bytes]:
        """Words of letters only are one unit each, whose last id is marked: many go through the tokenizer as one text.

        Returns what is left to do of ``open_``.
        """
        done = []
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                data = ids.astype("<u4").tobytes()
                self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
                done += part
        return open_.difference(done)

    def segments(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > SEGMENT:
            to = at + SEGMENT
            while to < len(text) and text[to] not in _SPACES:
                to += 1
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def folded(self, text: bytes) -> bytes:
        low = text.lower()
        return text if any(h in low for h in self.heads) else low

    def encode(self, text: bytes) -> bytes:
        out = []
        text = self.folded(text)
        for part in self.segments(text):
            words = part.split()
            new = set(words).difference(self.known)
            if new:
                if len(self.known) + len(new) > CACHE_WORDS:
                    self.known.clear()
                    new = set(words)
                self.learn(new)
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """``encode`` of several texts, with the new words of all of them looked up together."""
        low = [self.folded(t) for t in texts]
        if sum(map(len, low)) > 4 * SEGMENT:
            return [self.encode(t) for t in texts]
        words = [t.split() for t in low]
        new = set().union(*words).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = set().union(*words)
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, w)) for w in words]
