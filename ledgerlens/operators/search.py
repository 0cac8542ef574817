"""Vector and text search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import icontains, query_words, tokens, words_match, words_rank
from ledgerlens.skew import top_per_key


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null when a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def semantic_search(vectors: DataFrame, query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` rows closest to the query vector: one scan and a bounded top-k, no shuffle of the vectors."""
    score = cosine(doubles(vector), doubles(query))
    return vectors.select(key, score.alias("score")).where(F.col("score").isNotNull()).orderBy(
        F.col("score").desc(), F.col(key)).limit(k)


def semantic_search_batch(vectors: DataFrame, queries: Mapping[str, Sequence[float]], k: int = 10, vector: str = "embedding",
                          key: str = "vec_id") -> DataFrame:
    """Top ``k`` per named query vector. The queries are literals; each task forwards at most k rows per query."""
    qs = F.array(*[F.struct(F.lit(n).alias("query"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for n, v in queries.items()])
    scored = vectors.select(key, doubles(vector).alias("v"), F.inline(qs)).select(key, "query", cosine(F.col("v"), F.col("q")).alias("score"))
    return top_per_key(scored.where(F.col("score").isNotNull()), ["query"], [F.col("score").desc(), F.col(key)], k)


def search_text(docs: DataFrame, phrase: str, text: str = "text", name: str | None = None) -> DataFrame:
    """Documents that hold every word of the phrase (in text or name) or whose name holds the phrase, with their rank.

    A substring test per word runs first, so most texts are never split into tokens.
    """
    words = query_words(phrase)
    whole = F.concat_ws(" ", F.col(text), F.col(name)) if name else F.coalesce(F.col(text), F.lit(""))
    maybe = F.lit(bool(words))
    low = F.lower(whole)
    for w in words:
        maybe = maybe & F.contains(low, F.lit(w))
    in_name = icontains(name, phrase) if name else F.lit(False)
    d = docs.where(maybe | in_name).withColumn("__t", tokens(whole))
    return d.where(words_match(F.col("__t"), words) & F.lit(bool(words)) | in_name).withColumn(
        "rank", words_rank(F.col("__t"), words)).drop("__t")


def search_ranked(docs: DataFrame, phrase: str, k: int = 50, key: str = "doc_id", **kw) -> DataFrame:
    return search_text(docs, phrase, **kw).orderBy(F.col("rank").desc(), F.col(key)).limit(k)


def search_simple(docs: DataFrame, phrase: str, columns: Sequence[str]) -> DataFrame:
    """Substring search without case over the given columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(icontains(c, phrase), F.lit(False))
    return docs.where(test)
