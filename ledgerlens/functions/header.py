"""Header fields out of document text: label patterns over the whole text and anchors over lines."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.confidence import header_score
from ledgerlens.functions.normalize import amount_text, score

AMOUNT_FIELDS = ["subtotal", "vat", "total_amount"]

# Label and value pattern per field (searched without case, over joined lines). Four of them (invoice_number, subtotal, vat,
# total_amount) are narrower on purpose: a value does not run over a line break, and branches that can never win are left out.
LABEL_PATTERNS: dict[str, str] = {
    "invoice_number": r"(?:invoice\s+(?:number|no\.?|#))\s*[:\s]*([A-Z0-9\-/]+)",
    "invoice_date": r"(?:invoice\s+date|date|dated|issued)\s*[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    "vendor_name": r"(?:from|vendor|supplier|company|by)\s*[:\s]*([A-Za-z0-9\s&.,'-]+?)(?:\n|$)",
    "tax_id": r"(?:tax\s+id|tax\s+no|vat\s+no|ein|itin|tnid|afm|siret)\s*[:\s]*([A-Z0-9\-/]+)",
    "subtotal": r"(?:subtotal|sub[\s-]?total|net|net\s+amount)\s*[:\s]*([0-9][0-9,. ]*)",
    "vat": r"(?:vat|tax|sales\s+tax|gst|tva)\s*(?:\(.*?\)|[0-9]*%?)?\s*[:\s]*([0-9][0-9,. ]*)",
    "total_amount": r"(?:total|grand\s+total|total\s+amount|amount\s+due)\s*[:\s]*([0-9][0-9,. ]*)",
}

# Anchors in order of preference, and the shape of the value behind them (with case).
ANCHORS: dict[str, tuple[list[str], str]] = {
    "invoice_number": (["invoice", "inv", "number", "no:", "no.", "#"], r"([A-Z0-9\-/]+)"),
    "invoice_date": (["date:", "dated:", "issued:", "date"], r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    "vendor_name": (["from:", "vendor:", "supplier:", "company:"], r"([A-Za-z0-9\s&.,'-]+)"),
    "tax_id": (["tax id", "vat no", "tin", "ein"], r"([A-Z0-9\-/.]+)"),
    "subtotal": (["subtotal", "sub-total", "net"], r"([0-9,.\s]+)"),
    "vat": (["vat", "tax", "gst"], r"([0-9,.\s]+)"),
    "total_amount": (["total", "grand total", "amount due"], r"([0-9,.\s]+)"),
}

LABEL_BASE = 0.95
ANCHOR_BASE = 0.8
WINDOW = 3


def label_pattern(field: str) -> str:
    """No letter or digit may precede a label, so ``total`` does not match inside ``Subtotal``."""
    return r"(?im)(?<![\p{L}\p{N}])" + LABEL_PATTERNS[field]


def label_text(text: Column, field: str) -> Column:
    """What stands behind the label; empty when the label is not there."""
    return F.trim(F.regexp_extract(text, label_pattern(field), 1))


def label_value(found: Column, amount: Column | None, field: str) -> Column:
    """Normalized value of a label text; ``amount`` is its parsed form for money fields."""
    if field in AMOUNT_FIELDS:
        return F.coalesce(amount_text(amount), found)
    return F.upper(found) if field == "invoice_number" else found


def label_result(value: Column) -> Column:
    """struct<value, confidence>; null for an empty value."""
    return F.when(value != "", F.struct(value.alias("value"), header_score(score(LABEL_BASE), value).alias("confidence")))


def anchor_hits(lines: Column, lower: Column, field: str, window: int = WINDOW) -> Column:
    """Every candidate of a field: array of struct<confidence, line, turn, value>, ``line`` and ``turn`` (place and anchor) negative.

    A value stands behind an anchor in its line, else in the next lines. ``lower`` holds the lines in lower case. The pattern runs
    only on lines that hold an anchor and on the lines after them.
    """
    words, shape = ANCHORS[field]

    def value_in(text: Column) -> Column:
        return F.trim(F.coalesce(F.regexp_extract(text, shape, 1), F.lit("")), F.lit(" \t\r\n"))

    def found(text: Column, distance: int) -> Column:
        """The value of a line, null without one, so that ``coalesce`` leaves the lines behind the first value alone."""
        return F.get(F.filter(F.array(F.struct(value_in(text).alias("value"), F.lit(distance).alias("distance"))), lambda v: v["value"] != ""), F.lit(0))

    def hit(i, turn, w, low):
        rest = F.substr(F.get(lines, i), F.instr(low, w) + len(w))
        near = [rest, *[F.get(lines, i + k) for k in range(1, window + 1)]]
        return F.when(F.contains(low, F.lit(w)), F.struct(
            (-i).alias("line"), F.lit(-turn).alias("turn"), F.coalesce(*[found(t, d) for d, t in enumerate(near)]).alias("v")))

    hits = F.flatten(F.transform(lower, lambda low, i: F.filter(
        F.array(*[hit(i, turn, w, low) for turn, w in enumerate(words)]), lambda h: h.isNotNull() & h["v"].isNotNull())))

    def candidate(h):
        conf = anchor_confidence(h["v"]["value"], h["v"]["distance"], window)
        return F.struct(conf.alias("confidence"), h["line"].alias("line"), h["turn"].alias("turn"), h["v"]["value"].alias("value"))

    return F.transform(hits, candidate)


def anchor_table(fields: Sequence[str]) -> Column:
    """All anchors as an array of struct<field_name, turn, word>."""
    return F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(turn).alias("turn"), F.lit(w).alias("word"))
                     for f in fields for turn, w in enumerate(ANCHORS[f][0])])


def shaped_value(text: Column, field_name: Column, fields: Sequence[str]) -> Column:
    """The value that a text shows for the field named by a column; a pattern that several fields share is there once."""
    shapes: dict[str, list[str]] = {}
    for f in fields:
        shapes.setdefault(ANCHORS[f][1], []).append(f)
    cases = F
    for shape, names in shapes.items():
        cases = cases.when(field_name.isin(names), F.regexp_extract(text, shape, 1))
    return F.trim(F.coalesce(cases, F.lit("")), F.lit(" \t\r\n"))


def anchor_confidence(value: Column, distance: Column, window: int = WINDOW) -> Column:
    """Confidence of an anchored value by its distance in lines, halved for a value of one character."""

    def scores(factor):
        return F.array(*[F.lit(Decimal(str(round(x * factor, 4)))) for x in anchor_scores(window)]).cast("array<decimal(5,4)>")

    return F.element_at(F.when(F.length(value) < 2, scores(0.5)).otherwise(scores(1.0)), distance + 1)


def by_anchor(lines: Column, lower: Column, field: str, window: int = WINDOW) -> Column:
    """struct<value, confidence> of the best candidate: highest confidence, then the earlier line, then the earlier anchor; null when none."""
    return F.array_max(anchor_hits(lines, lower, field, window))


def anchor_scores(window: int) -> list[float]:
    """Confidence of an anchored value by its distance in lines: base of the distance times its proximity."""
    return [ANCHOR_BASE] + [(0.7 - 0.1 * k) * max(0.1, 1.0 - 0.15 * k) for k in range(1, window + 1)]
