"""The corpus pipeline: stages over the documents table, each built on one operator of ``ledgerlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns packed pieces.
Rows are documents of their own, also if they share an id. Extra columns of any name are carried along. Null texts pass all filters and are packed as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import packing, pii, superminhash, toxicity, winnowing
from ledgerlens.llm.queries import tokenizer
from ledgerlens.llm.samples import folded
from ledgerlens.llm.words import written


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [quoted(c) for c in docs.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(names: list[str]) -> Column:
    """Columns as one struct ``_row`` with fields c0, c1, ..."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels outside the held-out fold, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = folded("doc_id", 5) != 0
    network = toxicity.fit(docs.where(seen), labels.where(seen))
    scored = toxicity.score(docs, network, "doc_id", "text", carried(docs.columns))
    return scored.where("predicted = 0").select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 on five-word shingles: that of the smallest id (a null id last), of equal ids the first row.

    Rows are told apart by their number in the scan of the written documents, so ids may repeat or be null.
    """
    key = unused(docs, "_place")
    numbered = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")))
    kept = superminhash.near_duplicates(numbered, doc_id=key, size=5, percent=80).where("kept").select(F.col("doc_id.row").alias("_kept"))
    return numbered.join(kept, numbered[key]["row"] == kept["_kept"], "left_semi").drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A verdict depends on the text alone, so texts are matched by their hash."""
    key = unused(docs, "_text_hash")
    hashed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = winnowing.find_contamination(hashed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key)
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return hashed.join(bad, key, "left_anti").select(*columns_of(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    rest = [c for c in docs.columns if c != "text"]
    found = pii.find_spans(docs, pii.fit(docs), "doc_id", "text", True, carried(rest))
    columns = {c: F.col(f"_row.c{i}") for i, c in enumerate(rest)} | {"text": F.col("redacted")}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("redacted").cast(docs.schema["n_chars"].dataType), columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, with their ids."""
    return packing.packed(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", redact),
    ("packing", pack),
]

#: A trained network decides first and a tokenizer last, so the tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
