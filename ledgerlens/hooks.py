"""Places where users plug in their own code.

Classifiers and validators are Column builders, so they stay in the JVM. A user model that needs
Python runs batch-wise on the rows that the built-in stages left open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import classify, normalize
from ledgerlens.operators.validation import MANDATORY, SUPPORTED_FIELDS

CLASSIFIERS: dict[str, Callable[[Column], Column]] = dict(classify.CLASSIFIERS)
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "currency": lambda c: normalize.plain_amount(c).isNotNull(),
    "date": lambda c: normalize.plain_date(c).isNotNull(),
    "tax_id": normalize.plain_tax_id_ok,
}


def register_classifier(name: str, builder: Callable[[Column], Column]) -> None:
    CLASSIFIERS[name] = builder


def register_validator(name: str, builder: Callable[[Column], Column]) -> None:
    VALIDATORS[name] = builder


def register_type(name: str, fields: Sequence[str], mandatory: Sequence[str] = ()) -> None:
    """A document type handler: the fields to extract and those that must be there."""
    SUPPORTED_FIELDS[name] = list(fields)
    if mandatory:
        MANDATORY[name] = list(mandatory)


def classify_with(df: DataFrame, name: str, text: str, out: str = "doc_type") -> DataFrame:
    return df.withColumn(out, CLASSIFIERS[name](F.col(text)))


RESULT = "doc_id long, field_name string, value string, confidence double"


def model_stage(open_docs: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run ``model`` over Arrow batches of unresolved documents; it returns doc_id, field_name, value, confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield model(pdf)[["doc_id", "field_name", "value", "confidence"]]

    return open_docs.mapInPandas(run, RESULT)


def embed(df: DataFrame, text: str, model: Callable[[pd.Series], pd.Series], out: str = "embedding") -> DataFrame:
    """Vector column from a user model over whole texts; empty texts get null without a call."""
    udf = F.pandas_udf(model, "array<double>")
    filled = F.coalesce(F.col(text), F.lit("")) != ""
    return df.where(filled).withColumn(out, udf(F.col(text))).unionByName(
        df.where(~filled).withColumn(out, F.lit(None).cast("array<double>")))
