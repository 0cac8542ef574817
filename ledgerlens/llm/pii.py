"""Personal data: fixed patterns, and candidates scored by boosted trees.

The base spans come from four patterns with checks (Luhn, parts of an address, digit counts). Beyond them, generators propose every
stretch of text that looks remotely like an e-mail address, a network address, a card or a phone number; proposals of several kinds may
cover the same text. Boosted trees score a proposal by features of its format and of the text around it. They are fitted on a bounded
sample of the corpus without repeated texts. Its base spans are rewritten where they stand, in formats that the patterns miss (at-sign words, no plus,
other separators), and these are the positives beside the base spans; negatives are proposals of the sample that fail the format check of
their kind, and rewritten spans that were broken so that they fail it. A proposal that passes the check and is no known span has no label.
The threshold of each kind is the lowest that keeps the asked precision on rewritten spans and negatives of the whole
corpus (repeated texts once) whose spans the trees have not seen. Of overlapping selected proposals the best scored stays; base spans always stay.

Defined cases: null and empty texts have no spans; rows are independent, so repeated rows and ids give a row each; without any proposal in the
sample only base spans are found. Positions are code points. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import boosting
from ledgerlens.llm.words import blocks, text_bytes

KINDS = ("email", "ip", "card", "phone")
FOUND = tuple(f"{k}_like" for k in KINDS)
#: Bounds of the training sample of the trees (documents, proposals), the precision that thresholds keep, and the steps of a score in which
#: thresholds are looked for.
TRAIN_DOCS, TRAIN_PROPOSALS, PRECISION, STEPS = 6000, 40_000, 0.98, 1 << 16

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match cannot start inside a run of digits unless one starts at the run's head, so only heads are tried.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT = re.compile(r"@|[(\[]at[)\]]")
LEFT = re.compile(r"[^\s@]{1,64}[ ]?\Z")
TIGHT = re.compile(r"[A-Za-z0-9._%+-]{1,64}[ ]?\Z")
RIGHT = re.compile(r"[ ]?[^\s@]{1,128}")
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().:/-]{5,30}[0-9](?![0-9A-Za-z])")
SEPARATED = re.compile(r"[0-9]+")
DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind, then place."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of everything that may be personal data; spans of different kinds overlap."""
    out = []
    for m in AT.finditer(text):
        low = max(0, m.start() - 65)
        left, right = LEFT.search(text[low : m.start()]), RIGHT.match(text, m.end())
        if left and right:
            out.append((0, low + left.start(), right.end()))
            near, tight = TIGHT.search(text[low : m.start()]), DOMAIN.match(text, m.end() + (text[m.end()] == " "))
            if near and tight and (near.start(), tight.end()) != (left.start(), right.end()):
                out.append((0, low + near.start(), tight.end()))
    for m in NUMBER.finditer(text):
        n = len(digits_of(m[0]))
        if m[0].count(".") + m[0].count(":") == 3:
            out.append((1, *m.span()))
        if 12 <= n <= 20:
            out.append((2, *m.span()))
        if 7 <= n <= 16:
            out.append((3, *m.span()))
    return out


def plausible(kind: int, span: str) -> bool:
    """Whether a proposal has a possible format of its kind."""
    groups, n = SEPARATED.findall(span), len(digits_of(span))
    if kind == 0:
        local, *rest = AT.split(span)
        domain = rest[0].removeprefix(" ") if len(rest) == 1 else ""
        last = domain.rsplit(".", 1)[-1]
        return bool(TIGHT.fullmatch(local) and DOMAIN.fullmatch(domain)) and len(last) > 1 and last.isalpha()
    if kind == 1:
        return len(groups) == 4 and not set("()/-+") & set(span) and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == 2:
        return 13 <= n <= 19 and luhn("".join(groups))
    # A number without a plus is a phone number only in groups; times, dates, years and decimal numbers are none.
    if not (9 <= n <= 15 and 2 <= len(groups) <= 6 and max(map(len, groups)) >= 3 and ":" not in span and span.count("/") < 2):
        return False
    return not (len(groups) == 2 and "." in span or DATE.search(span) or all(len(g) == 4 and g[:2] in ("19", "20") for g in groups))


def rewritten_span(kind: str, span: str, draw: int) -> str:
    """A base span in a format that the patterns miss."""
    if kind == "email":
        return span.replace("@", (" [at] ", "[at]", " (at) ", "(at)", " @ ")[draw % 5])
    if kind == "ip":
        return span.replace(".", (":", " . ", ". ", " : ")[draw % 4])
    digits = digits_of(span)
    if kind == "card":
        return (".", "/", ":", "  ", " - ")[draw % 5].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = SEPARATED.findall(span)
    return (span[1:], f"00{span[1:]}", " ".join(groups), "-".join(groups), ".".join(groups))[draw % 5]


def broken_span(kind: str, span: str, draw: int) -> str:
    """A rewritten span that fails the format check of its kind."""
    if kind == "email":
        return span.replace(".", "") if draw % 2 else AT.split(span)[0] + "@ " + span[-1]
    if kind == "ip":
        return re.sub("[0-9]+", str(256 + draw % 744), span, count=1)
    if kind == "card":
        return span[:-1] + str((int(span[-1]) + 1 + draw % 9) % 10)
    return f"{span} {10**8 + draw % 10**8}" if draw % 2 else span[: len(span) // 2] + span[-1]


def rewritten(text: str, spans: list[tuple[str, int, int]], broken: bool) -> tuple[str, list[tuple[str, int, int, int]]]:
    """The text with its spans rewritten (of overlapping ones the first), and their (kind, start, end, hash) in it."""
    out, known, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        draw = zlib.crc32(text[a:b].encode())
        new = rewritten_span(kind, text[a:b], draw)
        new = broken_span(kind, new, draw // 20) if broken else new
        size += a - at
        known.append((kind, size, size + len(new), draw))
        out += [text[at:a], new]
        size, at = size + len(new), b
    return "".join([*out, text[at:]]), known


class Places:
    """Spans (kind, start, end, ...) by place, so that those at a stretch are found without a look at all."""

    def __init__(self, spans: list[tuple]):
        self.spans = sorted(spans, key=lambda s: s[1])
        self.starts = [s[1] for s in self.spans]
        self.reach = list(accumulate((s[2] for s in self.spans), max))

    def at(self, start: int, end: int) -> list[tuple]:
        out, i = [], bisect_left(self.starts, end)
        while i and self.reach[i - 1] > start:
            i -= 1
            if self.spans[i][2] > start:
                out.append(self.spans[i])
        return out


def examples(text: str) -> Iterator[tuple[list[float], float, bool, int]]:
    """(features, label, whether no base span is there, hash of the span) of a text's proposals that have a label."""
    base = base_spans(text)
    versions = [(text, [(k, a, b, zlib.crc32(text[a:b].encode())) for k, a, b in base])]
    versions += [rewritten(text, base, False), rewritten(text, base, True)] if base else []
    for n, (now, known) in enumerate(versions):
        found, known = Places(base_spans(now) if n else base), Places(known)
        for kind, a, b in proposals(now):
            near = known.at(a, b)
            # Rewriting adds nothing elsewhere.
            if n and not near:
                continue
            right = any(k == KINDS[kind] and min(b, d) - max(a, c) >= 0.9 * (max(b, d) - min(a, c)) for k, c, d, _ in near)
            if not plausible(kind, now[a:b]) or near and n < 2 and not any(k == KINDS[kind] for k, *_ in near):
                label = 0.0
            elif right and n < 2:
                label = 1.0
            else:
                continue
            yield features(now, kind, a, b), label, not found.at(a, b), near[0][3] if near else zlib.crc32(now[a:b].encode())


def char_class(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = digits_of(span)
    groups = SEPARATED.findall(span)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    around = before + after
    sign = AT.search(span)
    local, domain = (span[: sign.start()].strip(), span[sign.end() :].strip()) if sign else (span, "")
    last = domain.rsplit(".", 1)[-1] if "." in domain else ""
    return [
        kind, end - start, len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], span.count("."), span.count("-"), span.count(" "),
        span.count("(") + span.count(")"), span.count("/") + span.count(":"), float(span[:1] == "+"), float(luhn(digits)) if len(digits) > 7 else -1,
        max((min(int(g[:6]), 999) for g in groups), default=-1), len(local), len(domain), domain.count("."), len(last), float(last.isalpha() and last.isascii()),
        sum(c.isalpha() for c in span), char_class(text, start - 1), char_class(text, end), sum(c.isdigit() for c in around), sum(c.isalpha() for c in before[-8:]),
        sum(not c.isalnum() and not c.isspace() for c in around), float("@" in around), float(":" in before[-3:]), float("+" in before[-2:]),
        float(plausible(kind, span)),
    ]


FEATURES = len(features("", 0, 0, 0))


def overlaps(spans: list[tuple[str, int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


@dataclass
class Finder:
    trees: boosting.BoostedTrees
    thresholds: list[float]  # per kind; above 1: nothing is selected

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """All spans, base first: by kind, then place."""
        base = base_spans(text)
        open_ = [p for p in proposals(text) if not overlaps(base, p[1], p[2])]
        if not open_:
            return base
        scores = self.trees.score(np.array([features(text, *p) for p in open_]))
        more: list[tuple[str, int, int]] = []
        for i in sorted(range(len(open_)), key=lambda i: (-scores[i], open_[i])):
            kind, a, b = open_[i]
            if scores[i] >= self.thresholds[kind] and not overlaps(more, a, b):
                more.append((FOUND[kind], a, b))
        return base + sorted(more, key=lambda s: (FOUND.index(s[0]), s[1], s[2]))


def thresholds(steps: np.ndarray, seen: np.ndarray, right: np.ndarray, kinds: np.ndarray, precision: float) -> list[float]:
    """Per kind the lowest step of the score from which on the precision holds. seen, right: proposals and true ones per kind and step."""
    out = []
    for k in range(len(KINDS)):
        order = np.flatnonzero(kinds == k)
        order = order[np.argsort(-steps[order])]
        true = np.cumsum(right[order])
        good = np.flatnonzero((true >= precision * np.cumsum(seen[order])) & (true > 0))
        out.append(max(0.5, float(steps[order][good[-1]] / STEPS)) if len(good) else 2.0)
    return out


def held_out(span: np.ndarray) -> np.ndarray:
    """Spans kept from the trees. A span, its rewritten form and its copies are on one side."""
    return span % 3 == 0


def scored_examples(texts: DataFrame, trees: boosting.BoostedTrees) -> DataFrame:
    """kind, step, seen, right: how many held-out proposals of all texts have a score in a step, and how many of them are true. Equal texts count once."""
    shared = texts.sparkSession.sparkContext.broadcast(trees)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in blocks(batches, "text"):
            data, bounds = text_bytes(batch.column("text"))
            ids = batch.column("text_id").to_numpy()
            x, y, of, place = [], [], [], []
            for i in has_signs(data, bounds):
                for n, (row, label, missed, span) in enumerate(examples(data[bounds[i] : bounds[i + 1]].tobytes().decode())):
                    if missed and held_out(span):
                        x.append(row)
                        y.append(int(label))
                        of.append(ids[i])
                        place.append(n)
            x = np.array(x, float).reshape(-1, FEATURES)
            step = np.floor(trees.score(x) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), pa.array(place, pa.int64()), pa.array(x[:, 0].astype(np.int64)), pa.array(step), pa.array(y, pa.int64())],
                names=["text_id", "place", "kind", "step", "label"])

    rows = texts.select(F.xxhash64("text").alias("text_id"), "text").mapInArrow(scan, "text_id long, place long, kind long, step long, label long")
    return rows.dropDuplicates(["text_id", "place"]).groupBy("kind", "step").agg(F.count("*").alias("seen"), F.sum("label").alias("right"))


def has_signs(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents with a digit, an at sign or a bracket (no span lacks all)."""
    signs = ((data >= 48) & (data <= 57)) | (data == 64) | (data == 40) | (data == 91)
    seen = np.concatenate([[0], np.cumsum(signs)])
    return np.flatnonzero(seen[bounds[1:]] > seen[bounds[:-1]])


def fit(docs: DataFrame, text: str = "text", most: int = TRAIN_DOCS) -> Finder:
    """A finder: trees from at most about ``most`` documents, thresholds from all."""
    texts = docs.select(F.col(text).alias("text")).where("text is not null")
    total = texts.count()
    share = F.lit(most / max(total, 1))
    rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            data, bounds = text_bytes(batch.column("text"))
            got = [e for i in has_signs(data, bounds) for e in examples(data[bounds[i] : bounds[i + 1]].tobytes().decode())]
            x, y, missed, span = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(missed, pa.bool_()), pa.array(span, pa.int64())], names=["x", "y", "missed", "span"])

    found = rows.mapInArrow(scan, "x array<double>, y double, missed boolean, span long")
    sample = found.orderBy(F.xxhash64("x"), "y", "missed", "span").limit(TRAIN_PROPOSALS).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, FEATURES)
    y = sample["y"].to_numpy(float)
    held = held_out(sample["span"].to_numpy(np.int64))
    trees = boosting.fit(x[~held], y[~held])
    counts = scored_examples(texts, trees).toPandas().astype("int64")  # at most STEPS rows per kind
    return Finder(trees, thresholds(*(counts[c].to_numpy() for c in ("step", "seen", "right", "kind")), PRECISION))


def find_spans(docs: DataFrame, finder: Finder, doc_id: str = "doc_id", text: str = "text", redact: bool = False, *extra: Column) -> DataFrame:
    """A row per document: doc_id, ``extra`` columns, spans: array of (kind, start, end); with ``redact`` also the text without them.

    In a redacted text a span is replaced by its kind in angle brackets; of overlapping base spans the first replaces all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(finder)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind.removesuffix('_like')}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.value
        for batch in blocks(batches, "_text"):
            data, bounds = text_bytes(batch.column("_text"))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            texts = batch.column("_text").to_pylist() if redact else []
            for i in has_signs(data, bounds):
                text = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                found[i] = finder.find(text)
                if redact and found[i]:
                    texts[i] = clean(text, found[i])
            columns = [*batch.columns[:-1], pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], pa.list_(span))]
            names = [*batch.schema.names[:-1], "spans"]
            if redact:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), *extra, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{schema}, spans array<struct<kind:string,start:long,end:long>>" + (", redacted string" if redact else ""))
