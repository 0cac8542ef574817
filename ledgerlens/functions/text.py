"""Text, naming, mapping and config expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(text: Column | str) -> Column:
    """Lower case, runs of white space as one space, no white space at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def has_thai(text: Column | str) -> Column:
    return col(text).rlike("[฀-๿]")


def icontains(text: Column | str, part: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in ``part`` are plain characters."""
    return F.contains(F.lower(col(text)), F.lit(part.lower()))


def safe_export_name(doc_id: Column | str, name: Column | str, file_path: Column | str) -> Column:
    """File name for an export: id prefix, no path separators, the file's extension exactly once."""
    ident = col(doc_id).cast("string")
    base = F.trim(F.coalesce(F.when(col(name) != "", col(name)), ident))
    base = F.translate(F.when(base == "", ident).otherwise(base), "/\\", "__")
    ext = F.regexp_extract(col(file_path), r"[^/.](\.[^./]+)$", 1)
    has_ext = (ext != "") & F.endswith(F.lower(base), F.lower(ext))
    return F.concat(ident, F.lit("_"), base, F.when(has_ext, F.lit("")).otherwise(ext))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def query_words(phrase: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", phrase.lower())))  # letters and numbers, as in WORD


def words_match(toks: Column, words: Sequence[str]) -> Column:
    """True when every word is among the tokens."""
    wanted = F.array(*[F.lit(w) for w in words])
    return F.size(F.array_intersect(wanted, toks)) == len(words)


def words_rank(toks: Column, words: Sequence[str]) -> Column:
    """Share of tokens that are query words; 0 for an empty text."""
    hits = F.size(F.filter(toks, lambda t: t.isin(list(words))))
    return F.when(F.size(toks) > 0, hits / F.size(toks)).otherwise(F.lit(0.0))


def title_case(text: Column | str) -> Column:
    """Upper case after every non-letter, lower case elsewhere (so ``o'neil`` gives ``O'Neil``)."""
    runs = F.regexp_extract_all(col(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def capitalize(text: Column | str) -> Column:
    t = col(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))


TRANSFORMS = {
    "uppercase": F.upper, "lowercase": F.lower, "trim": F.trim, "title": title_case, "capitalize": capitalize,
}


def apply_transform(value: Column | str, name: str | None) -> Column:
    """Named value transform; an unknown or missing name leaves the value as it is."""
    return TRANSFORMS.get(name, col)(col(value))


TRUE_WORDS = ["true", "yes", "1"]


def cast_value(value: Column | str, data_type: str) -> Column:
    """Typed value, null where the text does not fit; compare with ``cast_ok``."""
    v = col(value)
    if data_type in ("number", "decimal"):
        return v.try_cast("decimal(28,6)")
    if data_type == "date":
        return v.try_cast("timestamp_ntz")
    if data_type == "boolean":
        return F.lower(v).isin(TRUE_WORDS)
    return v.cast("string")


def cast_ok(value: Column | str, data_type: str) -> Column:
    """False only where a present value fails its cast (the export then keeps the text)."""
    return col(value).isNull() | cast_value(value, data_type).isNotNull()


def config_value(raw: Column | str, default: str | None = None) -> Column:
    """Stored config text as text: a JSON string loses its quotes, other JSON and plain text (also JSON with more behind it) stay."""
    r = col(raw)
    one = F.try_parse_json(r).isNotNull() & (F.json_array_length(F.concat(F.lit("["), r, F.lit("]"))) == 1)
    value = F.when(one, F.coalesce(F.get_json_object(r, "$"), r)).otherwise(r)
    return F.coalesce(value, F.lit(default)) if default is not None else value


def json_property(doc: Column | str, path: str) -> Column:
    return F.get_json_object(col(doc), path)


def parse_bound(value: str | None, end_of_day: bool = False) -> Column | None:
    """Date bound of a filter: a bare date is the start or end of that day; null (no filter) when unreadable."""
    if not value:
        return None
    text = F.lit(value.strip())
    if len(value.strip()) == 10:
        day = text.try_cast("date")
        return (F.expr("interval '23:59:59.999999' hour to second") + day.cast("timestamp_ntz")) if end_of_day \
            else day.cast("timestamp_ntz")
    return text.try_cast("timestamp_ntz")
