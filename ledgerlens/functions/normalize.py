"""Dates, money, ids: parse, normalize and validate as expressions. Confidences are decimals, so sums are exact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import col

AMOUNT = "decimal(20,4)"
SCORE = "decimal(5,4)"

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
CURRENCY_SYMBOLS = "$₽€¥₹£฿"

# Thai month names, full and short, replaced in this order.
THAI_MONTHS = [
    ("มกราคม", 1), ("มค", 1), ("กุมภาพันธ์", 2), ("กพ", 2), ("มีนาคม", 3), ("มีค", 3), ("เมษายน", 4), ("เมย", 4),
    ("พฤษภาคม", 5), ("พค", 5), ("มิถุนายน", 6), ("มิย", 6), ("กรกฎาคม", 7), ("กค", 7), ("สิงหาคม", 8), ("สค", 8),
    ("กันยายน", 9), ("กย", 9), ("ตุลาคม", 10), ("ตค", 10), ("พฤศจิกายน", 11), ("พย", 11), ("ธันวาคม", 12), ("ธค", 12),
]


def score(x: float) -> Column:
    return F.lit(x).cast(SCORE)


def arabic_digits(text: Column | str) -> Column:
    return F.translate(col(text), THAI_DIGITS, "0123456789")


def month_numbers(text: Column | str) -> Column:
    """Thai month names as numbers. Texts without Thai letters skip the replacements, which run over an array to keep the compiled method short."""
    t = col(text)
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(str(number)).alias("number")) for name, number in THAI_MONTHS])
    return F.when(t.rlike("[ก-ฺ]"), F.aggregate(names, t, lambda out, m: F.replace(out, m["name"], m["number"]))).otherwise(t)


def gregorian_year(year: Column) -> Column:
    """Buddhist years (2400 and later) minus 543; 1901-2399 stay; anything else is null."""
    return F.when(year >= 2400, year - 543).when((year > 1900) & (year < 2400), year)


SEP = r"[/\-\s]+"
DATE_FORMATS = [
    # name, pattern, (year, month, day) groups, confidence
    ("DD/MM/YYYY", rf"(\d{{1,2}}){SEP}(\d{{1,2}}){SEP}(\d{{4}})", (3, 2, 1), 0.95),
    ("YYYY/MM/DD", rf"(\d{{4}}){SEP}(\d{{1,2}}){SEP}(\d{{1,2}})", (1, 2, 3), 0.85),
    ("DD/MM/YY", rf"(?<!\d)(\d{{1,2}}){SEP}(\d{{1,2}}){SEP}(\d{{2}})(?!\d)", (3, 2, 1), 0.85),
]


def date_text(text: Column | str) -> Column:
    """Trimmed text with Arabic digits and month numbers: what ``parse_clean_date`` reads."""
    return F.trim(month_numbers(arabic_digits(text)))


def date_parts(t: Column) -> list[Column]:
    """The number groups of the first match of each format in cleaned text. Project them before ``date_of_parts``: it reads them often."""
    return [F.split(F.regexp_extract(t, pattern, 0), SEP) for _, pattern, _, _ in DATE_FORMATS]


def date_of_parts(parts: list[Column]) -> Column:
    """struct<value: date, confidence, format>; null where no format gives a real date.

    The formats are tried as elements of an array: one expression for all of them, else the compiled method passes what the JVM compiles.
    """
    tries = []
    for (name, _, (y, m, d), conf), groups in zip(DATE_FORMATS, parts, strict=True):

        def part(g, groups=groups):
            return F.get(groups, g - 1).try_cast("int")

        year = part(y) + 2000 if name == "DD/MM/YY" else part(y)
        tries.append(F.struct(year.alias("y"), part(m).alias("m"), part(d).alias("d"), score(conf).alias("confidence"), F.lit(name).alias("format")))

    def real(t):
        iso = F.concat(F.lpad(gregorian_year(t["y"]).cast("string"), 4, "0"), F.lit("-"), F.lpad(t["m"].cast("string"), 2, "0"), F.lit("-"),
                       F.lpad(t["d"].cast("string"), 2, "0"))
        return F.struct(iso.try_cast("date").alias("value"), t["confidence"].alias("confidence"), t["format"].alias("format"))

    known = F.filter(F.array(*tries), lambda t: t["y"].isNotNull())
    return F.get(F.filter(F.transform(known, real), lambda x: x["value"].isNotNull()), F.lit(0))


def parse_clean_date(t: Column) -> Column:
    """struct<value: date, confidence, format> of cleaned text; null where no format gives a real date."""
    return date_of_parts(date_parts(t))


def parse_date(text: Column | str) -> Column:
    return parse_clean_date(date_text(text))


def date_problem(day: Column, today: Column) -> Column:
    """Null for a plausible date, else what is wrong with it."""
    return F.when(day.isNull(), "Date could not be parsed") \
        .when(day > today, F.concat(F.lit("Date "), day.cast("string"), F.lit(" is in the future"))) \
        .when(F.year(day) < 1900, F.concat(F.lit("Date "), day.cast("string"), F.lit(" is too old")))


def clean_amount(text: Column | str) -> Column:
    """Money text with Arabic digits, without symbols and spaces: what ``parse_clean_amount`` reads."""
    return F.translate(col(text), THAI_DIGITS + CURRENCY_SYMBOLS + " ", "0123456789")


def parse_clean_amount(t: Column) -> Column:
    """US or European number text as decimal(20,4); null where it is no number."""
    has_comma, has_period = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    periods = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    back = F.reverse(t)
    period_last = F.instr(back, ".") < F.instr(back, ",")
    no_commas = F.replace(t, F.lit(","), F.lit(""))
    no_periods = F.replace(t, F.lit("."), F.lit(""))
    comma_decimal = F.replace(no_periods, F.lit(","), F.lit("."))
    plain = (
        F.when(has_comma & has_period, F.when(period_last, no_commas).otherwise(comma_decimal))
        .when(has_comma, F.when(F.length(F.substring_index(t, ",", -1)) == 2, comma_decimal).otherwise(no_commas))
        .when(periods > 1, no_periods).otherwise(t)
    )
    number = F.regexp_extract(F.trim(plain), r"^[+-]?(?:\d+\.?\d*|\.\d+)$", 0)
    return F.when(number != "", number).try_cast(AMOUNT)


def parse_amount(text: Column | str) -> Column:
    return parse_clean_amount(clean_amount(text))


def amount_confidence(value: Column) -> Column:
    return F.when(value != 0, score(0.95)).when(value == 0, score(0.7)).otherwise(score(0.0))


def amount_text(value: Column) -> Column:
    """Decimal as text without trailing zeros but at least one decimal: 5500.0000 -> 5500.0."""
    return F.regexp_replace(value.cast("string"), r"(\.\d+?)0+$", "$1")


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[^0-9]", "")


def tax_id_problem(text: Column | str, weights: int = 12, digits: Column | None = None) -> Column:
    """Null for a valid 13-digit id (weights 13, 12, ... and modulo 11), else what is wrong. ``digits``: those of the text, projected before."""
    d = digits_only(text) if digits is None else digits
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(weights)), F.lit(0),
        lambda acc, i: acc + F.substr(d, i, F.lit(1)).try_cast("int") * (F.lit(14) - i))
    check = (F.lit(11) - total % 11) % 10
    last = F.substring(d, 13, 1).try_cast("int")
    return (
        F.when(col(text).isNull() | (col(text) == ""), "Tax ID is empty")
        .when(F.length(d) != 13, F.concat(F.lit("Tax ID must be 13 digits, got "), F.length(d).cast("string")))
        .when(check != last, "Tax ID checksum failed")
    )


def integer_text(text: Column | str, digits: Column | None = None) -> Column:
    """Digits without leading zeros; null when there is no digit."""
    d = digits_only(text) if digits is None else digits
    return F.when(d != "", F.regexp_replace(d, r"^0+(?=\d)", ""))


def amount_errors(subtotal: Column, vat: Column, total: Column, tolerance: float = 0.05) -> Column:
    """Array of problems in subtotal + vat = total; empty when fine or when subtotal or total is missing."""
    tax = F.coalesce(vat, F.lit(0).cast(AMOUNT))
    diff = F.abs(subtotal + tax - total)
    checks = [F.when(diff > F.lit(tolerance).cast(AMOUNT), F.lit("Amount mismatch"))]
    for name, value in (("subtotal", subtotal), ("vat", vat), ("total", total)):
        checks.append(F.when(value < 0, F.lit(f"{name} should not be negative")))
    known = subtotal.isNotNull() & total.isNotNull()
    found = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return F.when(known, found).otherwise(F.array().cast("array<string>"))


def resolve_mismatch(subtotal: Column, vat: Column, total: Column, conf: Mapping[str, Column]) -> Column:
    """struct<target, value, confidence>: the two amounts trusted most predict the third.

    ``conf`` has subtotal, vat and total_amount; a missing confidence counts 0.5.
    """
    c = {k: F.coalesce(v.cast("decimal(8,4)"), F.lit(0.5).cast("decimal(8,4)")) for k, v in conf.items()}
    cases = [
        ("total_amount", subtotal + vat, c["subtotal"] + c["vat"]),
        ("vat", total - subtotal, c["subtotal"] + c["total_amount"]),
        ("subtotal", total - vat, c["vat"] + c["total_amount"]),
    ]
    best = F.array_max(F.array(*[
        F.struct(pair.alias("pair"), F.lit(-i).alias("turn"), F.lit(name).alias("target"), value.cast(AMOUNT).alias("value"))
        for i, (name, value, pair) in enumerate(cases)
    ]))
    return F.struct(best["target"].alias("target"), best["value"].alias("value"),
                    (best["pair"].cast("double") / 2).alias("confidence"))


# How much a failed check takes from the confidence.
PENALTY = {"empty": 0.3, "date": 0.4, "bad_date": 0.2, "integer": 0.2, "currency": 0.3, "tax_id": 0.3}

# Type of each header field; the tax id comes under two names.
FIELD_TYPES = {
    "invoice_date": "date", "vendor_tax_id": "tax_id", "tax_id": "tax_id", "subtotal": "currency",
    "vat": "currency", "total_amount": "currency", "vendor_name": "text",
}


def field_type(name: Column | str, default: str = "text") -> Column:
    pairs = [F.lit(x) for kv in FIELD_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(name)), F.lit(default))


def check_field(value: Column, kind: Column, day: Column, amount: Column, digits: Column, whole: Column, day_issue: Column, tax_issue: Column) -> Column:
    """struct<normalized_value, is_valid, error_message, adjustment>; every invalid value needs review.

    The other columns are what the value is as a date, an amount, digits and an integer, and what is wrong with it as a date and a
    tax id (``parse_date``, ``parse_amount``, ``digits_only``, ``integer_text``, ``date_problem``, ``tax_id_problem``), projected before, so
    that each text is parsed once.
    """
    v, k = value, kind

    def result(norm, error, adjustment):
        return F.struct(
            norm.alias("normalized_value"), error.isNull().alias("is_valid"),
            error.cast("string").alias("error_message"), adjustment.cast(SCORE).alias("adjustment"))

    none = F.lit(None).cast("string")
    one = F.lit(1).cast(SCORE)
    return (
        F.when(v.isNull() | (v == ""), result(none, F.lit("Field is empty"), score(PENALTY["empty"])))
        .when(k == "date", F.when(day.isNull(), result(v, F.lit("Could not parse date"), score(PENALTY["date"])))
              .otherwise(result(day["value"].cast("string"), day_issue,
                                F.when(day_issue.isNull(), one - day["confidence"]).otherwise(score(PENALTY["bad_date"])))))
        .when(k == "currency", F.when(amount.isNull(), result(v, F.lit("Could not parse currency"), score(PENALTY["currency"])))
              .otherwise(result(amount_text(amount), none, one - amount_confidence(amount))))
        .when(k == "tax_id", result(F.when(F.length(digits) == 13, digits).otherwise(v), tax_issue,
                                    F.when(tax_issue.isNull(), score(0.0)).otherwise(score(PENALTY["tax_id"]))))
        .when(k == "integer", F.when(whole.isNull(), result(v, F.lit("Could not parse as integer"), score(PENALTY["integer"])))
              .otherwise(result(whole, none, score(0.0))))
        .otherwise(result(v, none, score(0.0)))
    )


# Plain validators: the short forms without confidences.

PLAIN_DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
                      "MMMM d, yyyy", "yyyyMMdd"]


def plain_amount(text: Column | str) -> Column:
    return F.trim(F.translate(col(text), ",$", "")).try_cast(AMOUNT)


def plain_date(text: Column | str) -> Column:
    """First fitting format, month first where both fit."""
    return F.coalesce(*[F.try_to_date(col(text), f) for f in PLAIN_DATE_FORMATS])


def plain_tax_id_ok(text: Column | str) -> Column:
    return F.length(digits_only(text)) == 13
