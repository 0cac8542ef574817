"""Explicit schemas of the document store and the enumerations its string columns hold."""

from __future__ import annotations

from pyspark.sql import types as T

CONFIDENCE = T.DecimalType(5, 4)
MONEY = T.DecimalType(18, 2)

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("user_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("confidence", CONFIDENCE),
    T.StructField("created_at", T.TimestampNTZType()),
])

EXTRACTED_FIELDS = T.StructType([
    T.StructField("field_id", T.LongType(), False),
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("field_name", T.StringType()),
    T.StructField("field_value", T.StringType()),
    T.StructField("confidence", CONFIDENCE),
    T.StructField("is_corrected", T.BooleanType()),
    T.StructField("is_edited", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

FIELD_CORRECTIONS = T.StructType([
    T.StructField("correction_id", T.LongType(), False),
    T.StructField("field_id", T.LongType(), False),
    T.StructField("user_id", T.LongType()),
    T.StructField("corrected_at", T.TimestampNTZType()),
    T.StructField("original_value", T.StringType()),
    T.StructField("corrected_value", T.StringType()),
    T.StructField("correction_reason", T.StringType()),
    T.StructField("feedback_sentiment", T.StringType()),
    T.StructField("is_critical", T.BooleanType()),
    T.StructField("confidence_adjustment", CONFIDENCE),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

BOX = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("box_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("x_min", T.DoubleType()),
    T.StructField("y_min", T.DoubleType()),
    T.StructField("x_max", T.DoubleType()),
    T.StructField("y_max", T.DoubleType()),
])

# One result of an external OCR engine.
EXTERNAL_PAYLOAD = T.StructType([
    T.StructField("status", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("interface_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("result", T.ArrayType(T.StructType([
        T.StructField("doc_type", T.StringType()),
        T.StructField("pages", T.ArrayType(T.IntegerType())),
        T.StructField("data", T.MapType(T.StringType(), T.StructType([
            T.StructField("page", T.IntegerType()),
            T.StructField("value", T.StringType()),
            T.StructField("bbox", T.StructType([
                T.StructField("top", T.DoubleType()),
                T.StructField("left", T.DoubleType()),
                T.StructField("right", T.DoubleType()),
                T.StructField("bottom", T.DoubleType()),
            ])),
        ]))),
    ]))),
])

# Status and reason vocabularies.
TERMINAL_JOB_STATUSES = ["completed", "error", "cancelled"]
ACTIVE_JOB_STATUSES = ["triggered", "running"]
ROUTING_STATUSES = ["approved", "review_required", "rejected"]
HEADER_FIELDS = [
    "invoice_number", "invoice_date", "vendor_name", "tax_id", "subtotal", "vat", "total_amount",
]
SENTIMENT_RANK = {"unusable": 0, "poor": 1, "good": 2, "excellent": 3}
