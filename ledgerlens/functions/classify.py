"""Document type classifiers over a text column."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import col, normalize_text


@dataclass(frozen=True)
class KeywordSet:
    primary: Sequence[str]
    secondary: Sequence[str] = field(default_factory=list)
    tertiary: Sequence[str] = field(default_factory=list)
    negative: Sequence[str] = field(default_factory=list)
    threshold: float = 0.3

    def positive(self) -> list[str]:
        return [*self.primary, *self.secondary, *self.tertiary]


# Keyword lists and thresholds of the four document types. A result depends on every
# entry, so they are given as they are. Order of the types decides ties.
KEYWORD_SETS: dict[str, KeywordSet] = {
    "invoice": KeywordSet(
        primary=["invoice", "ใบแจ้งหนี้", "ืบแจ้งหนี้", "invoice number", "inv", "inv-", "inv."],
        secondary=["bill", "vendor", "supplier", "customer", "amount due", "total amount", "due date",
                   "payment terms", "tax", "เลขที่", "วันที่", "ผู้ขาย", "ผู้ซื้อ"],
        tertiary=["amount", "price", "quantity", "description", "total", "subtotal", "discount", "vat",
                  "บาท", "จำนวน", "ราคา"],
        negative=["receipt", "cash register", "pos", "store receipt"],
        threshold=0.25,
    ),
    "receipt": KeywordSet(
        primary=["receipt", "ใบเสร็จ", "ใบเสร็จรับเงิน", "thank you", "paid", "cash", "payment received"],
        secondary=["store", "shop", "counter", "cashier", "transaction", "items", "subtotal", "change",
                   "customer", "บริษัท", "ขอบคุณ", "ชำระแล้ว"],
        tertiary=["item", "qty", "price", "total", "amount", "date", "time", "number", "bill", "ราคา",
                  "จำนวน", "วันที่"],
        negative=["invoice", "invoice number", "po", "purchase order"],
        threshold=0.2,
    ),
    "purchase_order": KeywordSet(
        primary=["purchase order", "po", "po.", "p.o.", "purchase requisition", "order form", "order number"],
        secondary=["vendor", "supplier", "ship to", "deliver to", "delivery date", "expected delivery", "terms",
                   "condition", "order date", "requested by", "approved by", "ส่ง", "ผู้จัดจำหน่าย"],
        tertiary=["item", "description", "quantity", "unit price", "total", "amount", "specification", "qty",
                  "ราคา", "จำนวน", "รวม"],
        negative=["invoice", "receipt", "paid", "payment"],
        threshold=0.3,
    ),
    "tax_invoice": KeywordSet(
        primary=["tax", "vat", "vat invoice", "ใบกำกับภาษีอากร", "ใบแจ้งหนี้", "tax id", "tax number", "tin",
                 "เลขที่ประจำตัวผู้เสียภาษีอากร"],
        secondary=["invoice", "bill", "tax rate", "total tax", "amount including tax", "net amount", "customer",
                   "vendor", "ภาษีมูลค่าเพิ่ม", "สำนักพิมพ์", "ผู้เสียภาษี"],
        tertiary=["amount", "total", "price", "item", "quantity", "date", "number", "by order", "authorized",
                  "บาท", "รวม"],
        negative=["receipt", "pos", "cash register"],
        threshold=0.35,
    ),
}

# Substring patterns of the pattern classifier.
PATTERNS: dict[str, list[str]] = {
    "invoice": ["invoice", "tax invoice", "ใบแจ้งหนี้", "ใบกำกับภาษี", "bill"],
    "receipt": ["receipt", "official receipt", "ใบเสร็จรับเงิน", "slip"],
    "purchase_order": ["purchase order", "ใบสั่งซื้อ", "po"],
}

# Weights in tenths: exact integers, so the sum does not depend on its order.
PRIMARY, SECONDARY, TERTIARY, NEGATIVE = 10, 6, 3, -20


def keyword_regex(keyword: str, strict_edges: bool = False) -> str:
    """Java pattern: a letter or digit at the keyword's edge needs a non-word neighbour.

    With ``strict_edges`` an edge that is a mark or punctuation needs a word neighbour instead.
    """
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", keyword)

    def edge(ch: str, free: str, bound: str) -> str:
        if ch.isalnum() or ch == "_":
            return free
        return bound if strict_edges else ""

    left = edge(keyword[0], r"(?<![\p{L}\p{N}_])", r"(?<=[\p{L}\p{N}_])")
    right = edge(keyword[-1], r"(?![\p{L}\p{N}_])", r"(?=[\p{L}\p{N}_])")
    return left + quoted + right


def keyword_hits(text: Column | str, sets: Mapping[str, KeywordSet] = KEYWORD_SETS, strict_edges: bool = False) -> Column:
    """All distinct keywords found in the normalized text, each searched once for all types.

    The cheap ``contains`` guards the regex, so most keywords cost one substring scan.
    """
    t = col(text)
    words = dict.fromkeys(w for s in sets.values() for w in [*s.positive(), *s.negative])
    found = [
        F.when(F.contains(t, F.lit(w)) & t.rlike(keyword_regex(w, strict_edges)), F.lit(w)) for w in words
    ]
    return F.filter(F.array(*found), lambda w: w.isNotNull())


def _count(hits: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(0)
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), hits))


def keyword_classify(
    df: DataFrame,
    text: str,
    header: str | None = None,
    sets: Mapping[str, KeywordSet] = KEYWORD_SETS,
    strict_edges: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Adds ``doc_type``, ``type_confidence``, ``matched_keywords`` and one ``score_<type>`` per type.

    Each step is its own projection, so the hit list is evaluated once per document.
    """
    whole = F.concat_ws(" ", F.when(F.col(header) != "", F.col(header)), F.col(text)) if header else F.col(text)
    df = df.withColumn("__norm", normalize_text(whole))
    df = df.withColumn("__hits", keyword_hits("__norm", sets, strict_edges)).drop("__norm")
    hits = F.col("__hits")
    tenths = {
        name: F.greatest(
            F.lit(0),
            _count(hits, s.primary) * PRIMARY + _count(hits, s.secondary) * SECONDARY
            + _count(hits, s.tertiary) * TERTIARY + _count(hits, s.negative) * NEGATIVE,
        )
        for name, s in sets.items()
    }
    df = df.withColumns({f"{prefix}score_{n}": c / F.lit(10.0) for n, c in tenths.items()})
    best = F.array_max(F.array(*[
        F.struct(F.col(f"{prefix}score_{n}").alias("score"), F.lit(-i).alias("turn"), F.lit(n).alias("type"),
                 F.lit(float(s.threshold)).alias("threshold"))
        for i, (n, s) in enumerate(sets.items())
    ]))
    df = df.withColumn("__best", best)
    known = F.col("__best.score") >= F.col("__best.threshold")
    df = df.withColumn(f"{prefix}doc_type", F.when(known, F.col("__best.type")).otherwise("unknown"))
    df = df.withColumn(
        f"{prefix}type_confidence", F.when(known, F.least(F.lit(1.0), F.col("__best.score"))).otherwise(F.lit(0.0)))
    matches = F.lit(None).cast("array<string>")
    for n, s in sets.items():
        words = F.array(*[F.lit(w) for w in s.positive()])
        matches = F.when(F.col(f"{prefix}doc_type") == n, F.array_intersect(words, hits)).otherwise(matches)
    empty = F.array().cast("array<string>")
    return df.withColumn(f"{prefix}matched_keywords", F.coalesce(matches, empty)).drop("__best", "__hits")


def length_classify(text: Column | str) -> Column:
    """Length heuristic: struct<type, confidence>. Long texts favour invoices, wordy ones receipts."""
    t = col(text)
    long_text = F.length(t) > 1000
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.length(w) > 3)
    wordy = F.size(words) > 100
    hundredths = [
        ("invoice", F.when(long_text, 60).otherwise(50)),
        ("receipt", F.when(wordy, 60).otherwise(50)),
        ("purchase_order", F.lit(40)),
        ("tax_invoice", F.when(long_text, 60).otherwise(45)),
    ]
    best = F.array_max(F.array(*[
        F.struct(s.alias("score"), F.lit(-i).alias("turn"), F.lit(n).alias("type")) for i, (n, s) in enumerate(hundredths)
    ]))
    return F.struct(best["type"].alias("type"), (best["score"] / F.lit(100.0)).alias("confidence"))


def hybrid_classify(df: DataFrame, text: str, second: Column | None = None, low: float = 0.4, high: float = 0.8) -> DataFrame:
    """Keyword result; below ``low`` the second model's struct<type, confidence> replaces it.

    Adds ``doc_type``, ``type_confidence``, ``method`` and ``keyword_backup_score``.
    """
    df = keyword_classify(df, text, prefix="kw_")
    conf = F.col("kw_type_confidence")
    use_second = (conf < low) if second is not None else F.lit(False)
    df = df.withColumn("__second", F.when(use_second, second)) if second is not None else df.withColumn(
        "__second", F.lit(None).cast("struct<type:string,confidence:double>"))
    return df.select(
        *[c for c in df.columns if not c.startswith(("kw_", "__"))],
        F.coalesce("__second.type", "kw_doc_type").alias("doc_type"),
        F.coalesce("__second.confidence", "kw_type_confidence").alias("type_confidence"),
        F.when(conf >= high, "keyword_high_confidence").when(use_second, "second_model")
        .otherwise("keyword_medium_confidence").alias("method"),
        F.when(use_second, conf).alias("keyword_backup_score"),
    )


def pattern_classify(text: Column | str, definitions: Mapping[str, Sequence[str]] | None = None,
                     ratio: float = 1.5, default: str = "invoice") -> Column:
    """Most substring hits wins if it has more than ``ratio`` times the second; else ``default``.

    ``definitions`` adds types (name -> names to look for). Reads the whole text.
    """
    t = F.lower(col(text))
    patterns = {**PATTERNS, **{n: [w.lower() for w in ws] for n, ws in (definitions or {}).items()}}
    scores = []
    for i, (name, words) in enumerate(patterns.items()):
        total = F.lit(0)
        for w in words:
            total = total + F.contains(t, F.lit(w)).cast("int")
        scores.append(F.struct(total.alias("score"), F.lit(-i).alias("turn"), F.lit(name).alias("type")))
    ranked = F.reverse(F.array_sort(F.array(*scores)))
    top, second = ranked[0], ranked[1]
    clear = (top["score"] > 0) & (top["score"] > second["score"] * F.lit(ratio))
    return F.when(clear, top["type"]).otherwise(F.lit(default))


CLASSIFIERS = {"pattern": pattern_classify, "length": lambda text: length_classify(text)["type"]}
