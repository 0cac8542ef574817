"""Lists, filters, details and edits of the document store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import icontains, parse_bound
from ledgerlens.schemas import ACTIVE_JOB_STATUSES, TERMINAL_JOB_STATUSES
from ledgerlens.skew import nested_parts, top_per_key

SORTABLE = {"created_at", "name", "type", "status", "confidence", "doc_id"}


def filter_documents(
    docs: DataFrame,
    user_id: int | None = None,
    status: str | None = None,
    doc_type: str | None = None,
    name: str | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
    confidence_min: float | None = None,
    confidence_max: float | None = None,
) -> DataFrame:
    """Conjunction of the given filters; an unreadable date bound filters nothing."""
    conditions: list[Column] = []
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if status:
        conditions.append(F.col("status") == status)
    if doc_type:
        conditions.append(F.col("type") == doc_type)
    if name:
        conditions.append(icontains("name", name))
    for bound, op in ((parse_bound(created_from), "ge"), (parse_bound(created_to, True), "le")):
        if bound is not None:
            test = F.col("created_at") >= bound if op == "ge" else F.col("created_at") <= bound
            conditions.append(bound.isNull() | test)
    if confidence_min is not None:
        conditions.append(F.col("confidence") >= confidence_min)
    if confidence_max is not None:
        conditions.append(F.col("confidence") <= confidence_max)
    for c in conditions:
        docs = docs.where(c)
    return docs


def page_of(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing: ``limit`` rows after the first ``offset``."""
    if limit < 1 or offset < 0:
        raise ValueError(f"a page needs a limit of 1 or more and an offset of 0 or more, not {limit} and {offset}")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_first(key: str = "doc_id") -> list[Column]:
    return [F.col("created_at").desc(), F.col(key).desc()]


def sort_by(df: DataFrame, column: str, descending: bool = False, key: str = "doc_id") -> DataFrame:
    """Order by a column of the allow list, the id breaks ties."""
    if column not in SORTABLE:
        column = "created_at"
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key))


def filter_audit_logs(
    logs: DataFrame,
    is_admin: bool,
    actor: int,
    action: str | None = None,
    entity_type: str | None = None,
    document_id: int | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
) -> DataFrame:
    """Audit rows; someone who is no admin sees only their own."""
    if not is_admin:
        logs = logs.where(F.col("actor_user_id") == actor)
    for column, value in (("action", action), ("entity_type", entity_type), ("document_id", document_id)):
        if value is not None:
            logs = logs.where(F.col(column) == value)
    start, end = parse_bound(created_from), parse_bound(created_to, True)
    if start is not None:
        logs = logs.where(start.isNull() | (F.col("created_at") >= start))
    if end is not None:
        logs = logs.where(end.isNull() | (F.col("created_at") <= end))
    return logs


def latest_job_states(job_events: DataFrame) -> DataFrame:
    """One row per job: its last state by (time, event id). Partial aggregation, no per-job sort."""
    last = F.max_by(F.struct("document_id", "provider", "status", "event_time"), F.struct("event_time", "event_id"))
    return job_events.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")


def list_jobs(states: DataFrame, docs: DataFrame, provider: str | None = None, statuses: Sequence[str] | None = None) -> DataFrame:
    """Jobs with the name, type and status of their document."""
    if provider:
        states = states.where(F.col("provider") == provider)
    if statuses:
        states = states.where(F.col("status").isin(list(statuses)))
    d = docs.select(
        F.col("doc_id").alias("document_id"), F.col("name").alias("document_name"),
        F.col("type").alias("document_type"), F.col("status").alias("document_status"))
    return states.join(d, "document_id")


def active_jobs(states: DataFrame, docs: DataFrame) -> DataFrame:
    return list_jobs(states, docs, statuses=ACTIVE_JOB_STATUSES)


def job_history(states: DataFrame, docs: DataFrame) -> DataFrame:
    return list_jobs(states, docs, statuses=TERMINAL_JOB_STATUSES)


def job_backlog(states: DataFrame) -> DataFrame:
    """Queue depth by state."""
    return states.groupBy("status").agg(F.count("*").alias("jobs"))


def latest_completed_result(job_events: DataFrame) -> DataFrame:
    """Per document the event of its newest completed job."""
    done = job_events.where(F.col("status") == "completed")
    return done.groupBy("document_id").agg(
        F.max_by(F.struct("job_id", "event_id", "event_time"), F.struct("event_time", "event_id")).alias("r")
    ).select("document_id", F.col("r.job_id").alias("job_id"), F.col("r.event_id").alias("result_event_id"),
             F.col("r.event_time").alias("completed_at"))


def documents_idle_after_cancel(states: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Documents of the cancelled jobs that no other job still works on."""
    busy = states.where(F.col("status").isin("pending", *ACTIVE_JOB_STATUSES)).join(cancelled, "job_id", "left_anti")
    docs = states.join(cancelled, "job_id", "left_semi").select("document_id").distinct()
    return docs.join(busy, "document_id", "left_anti")


def document_details(docs: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Long form of a document with its pages and fields; a document's rows stand together, by page and field."""
    kept = docs.select("doc_id", "name", "type", "status")
    page_rows = pages.select("doc_id", F.col("page_number").cast("int").alias("page_number"), F.lit("page").alias("part"),
                             F.lit(None).cast("long").alias("field_id"), F.lit(None).cast("string").alias("field_name"),
                             F.lit(None).cast("string").alias("field_value"))
    field_rows = fields.select("doc_id", F.col("page_number").cast("int").alias("page_number"), F.lit("field").alias("part"),
                               "field_id", "field_name", "field_value")
    return kept.join(page_rows.unionByName(field_rows), "doc_id").repartition("doc_id").sortWithinPartitions(
        "doc_id", "page_number", F.col("field_id").asc_nulls_first())


def assemble(docs: DataFrame, fields: DataFrame, pages: DataFrame, results: DataFrame, part_size: int = 10000) -> DataFrame:
    """Nested documents: pages, header fields and line-item fields as arrays plus the newest OCR result.

    A document with more than ``part_size`` fields comes as several rows (``part``), so no row grows
    without bound and nothing is dropped; pages and result stand in each of them.
    """
    item = F.struct("field_id", "field_name", "field_value", "confidence", "page_number",
                    F.when(F.col("is_edited"), "manual").otherwise("ocr").alias("source"))
    f = nested_parts(fields, "doc_id", "field_id", item, "fields", part_size)
    p = pages.groupBy("doc_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))
    r = results.withColumnRenamed("document_id", "doc_id")
    return docs.join(f, "doc_id", "left").join(p, "doc_id", "left").join(r, "doc_id", "left").select(
        "doc_id", "name", "type", "status", "confidence", F.coalesce("part", F.lit(0)).alias("part"), "pages",
        F.filter("fields", lambda x: ~F.startswith(x["field_name"], F.lit("item_"))).alias("header_fields"),
        F.filter("fields", lambda x: F.startswith(x["field_name"], F.lit("item_"))).alias("item_fields"),
        "result_event_id")


def assembled_sizes(docs: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Scalar view of the assembled document: sizes and first and last parts, without building arrays."""
    f = fields.groupBy("doc_id").agg(
        F.count("*").alias("field_count"), F.count_if("is_edited").alias("manual_fields"),
        F.min_by("field_name", "field_id").alias("first_field"), F.max_by("field_name", "field_id").alias("last_field"))
    p = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.max("page_number").alias("last_page"))
    return docs.select("doc_id", "type").join(f, "doc_id", "left").join(p, "doc_id", "left")


def document_stats(docs: DataFrame) -> DataFrame:
    """Total, by status and by type in one pass."""
    return (
        docs.groupingSets([[], ["status"], ["type"]], "status", "type")
        .agg(F.count("*").alias("documents"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "status").otherwise("type").alias("dimension"),
            F.when(F.col("g") == 1, F.col("status")).when(F.col("g") == 2, F.col("type")).alias("value"),
            "documents")
    )


def daily_counts(docs: DataFrame, now: str, days: int) -> DataFrame:
    """Documents per day for the last ``days`` days, days without documents as 0."""
    if days < 1:
        raise ValueError(f"the number of days must be 1 or more, not {days}")
    last = F.lit(now).cast("date")
    first = F.date_sub(last, days - 1)
    spark = docs.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    counts = (
        docs.where((F.col("created_at") >= first.cast("timestamp_ntz"))
                   & (F.col("created_at") < F.date_add(last, 1).cast("timestamp_ntz")))
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    )
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("documents"))


def dimension_counts(dimension: DataFrame, rows: DataFrame, key: str, out: str) -> DataFrame:
    """Count of rows per dimension member, 0 for unused members, null keys ignored; counts before the join."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return dimension.join(counts, key, "left").withColumn(out, F.coalesce("__n", F.lit(0))).drop("__n")


def unmatched(docs: DataFrame, links: DataFrame) -> DataFrame:
    return docs.join(links, F.col("doc_id") == F.col("document_id"), "left_anti")


def match_sets(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Sets with their members, one row per member, with the size of the set."""
    sizes = links.groupBy("set_id").agg(F.count("*").alias("members"))
    d = docs.select(F.col("doc_id").alias("document_id"), "name", "type", "status")
    return links.join(sizes, "set_id").join(d, "document_id")


def membership_conflicts(requested: DataFrame, links: DataFrame) -> DataFrame:
    """Requested (set, document) links whose document already belongs to another set."""
    other = links.select("document_id", F.col("set_id").alias("other_set"))
    r = requested.join(links, ["set_id", "document_id"], "left_anti")
    return r.join(other, "document_id").where(F.col("other_set") != F.col("set_id"))


def invalid_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(known, key, "left_anti")


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def replace_links(links: DataFrame, replacement: DataFrame, owner: str) -> DataFrame:
    """Link table after the owners in ``replacement`` got a new set of links."""
    touched = replacement.select(owner).distinct()
    return links.join(touched, owner, "left_anti").unionByName(replacement.distinct())


def replace_valid_links(links: DataFrame, replacement: DataFrame, owner: str, member: str, known: DataFrame) -> DataFrame:
    """``replace_links`` for the owners whose new members are all known; a request with an unknown member changes nothing."""
    refused = replacement.select(owner, member).join(known, member, "left_anti").select(owner).distinct()
    return replace_links(links, replacement.join(refused, owner, "left_anti"), owner)


def delete_with_cascade(doomed: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Every child table (key ``doc_id``) without the rows of the doomed documents."""
    return {name: child.join(doomed, "doc_id", "left_anti") for name, child in children.items()}


def delete_categories(docs: DataFrame, doomed: DataFrame) -> DataFrame:
    """Documents keep living when their category goes: the reference becomes null."""
    gone = doomed.select("category_id", F.lit(True).alias("__gone")).distinct()
    return docs.join(gone, "category_id", "left").withColumn(
        "category_id", F.when(F.col("__gone").isNull(), F.col("category_id"))).drop("__gone")


def apply_review_actions(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """approve -> completed, reject -> error with a message, other actions change nothing. One action per document."""
    a = actions.select("doc_id", "action")
    return docs.join(a, "doc_id", "left").select(
        *[c for c in docs.columns if c != "status"],
        F.when(F.col("action") == "approve", "completed").when(F.col("action") == "reject", "error")
        .otherwise(F.col("status")).alias("status"),
        F.when(F.col("action") == "reject", "A reviewer turned the document down").alias("error_message"),
        F.when(F.col("action").isin("approve", "reject"), "success")
        .when(F.col("action").isNotNull(), "ignored").alias("review_result"))


def apply_review_corrections(fields: DataFrame, actions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields after the corrections (doc_id, field_name, value) that came with an approval: value written, field marked.

    Of several fields of a name the first is corrected; names that a document lacks and corrections without an approval change nothing.
    """
    approved = actions.where("action = 'approve'").select("doc_id").distinct()
    wanted = corrections.join(approved, "doc_id", "left_semi").groupBy("doc_id", "field_name").agg(F.max(F.struct("value")).alias("new"))
    first = fields.groupBy("doc_id", "field_name").agg(F.min("field_id").alias("field_id"))
    hit = first.join(wanted, ["doc_id", "field_name"]).select("field_id", "new")
    return fields.join(hit, "field_id", "left").select(
        *[c for c in fields.columns if c not in ("field_value", "is_corrected")],
        F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col("field_value")).alias("field_value"),
        (F.col("is_corrected") | F.col("new").isNotNull()).alias("is_corrected"))


def vendor_values(fields: DataFrame) -> DataFrame:
    """Vendor-like field values: doc_id, field_id, vendor."""
    return fields.where(F.contains(F.lower("field_name"), F.lit("vendor")) & (F.col("field_value") != "")).select(
        "doc_id", "field_id", F.col("field_value").alias("vendor"))


def similar_documents(docs: DataFrame, fields: DataFrame, k: int = 5) -> DataFrame:
    """For every document the newest ``k`` others of its owner that share its type and its vendor.

    Type ``unknown`` and a missing vendor don't restrict: such a document is compared by the other one alone, or with all of
    its owner's documents. Its vendor is that of its first vendor-like field; others match by any of theirs. The k + 1 newest
    of each (owner, type, vendor), (owner, type), (owner, vendor) and (owner) serve all documents, so no pairs are formed inside a group.
    """
    d = docs.select("doc_id", "user_id", "created_at", F.when(F.col("type") != "unknown", F.col("type")).alias("t"), F.col("type").alias("any_type"))
    values = vendor_values(fields)
    first = values.groupBy("doc_id").agg(F.min_by("vendor", "field_id").alias("v"))
    asking = d.join(first, "doc_id", "left")
    vendors = d.join(values.select("doc_id", "vendor").distinct(), "doc_id")
    none = F.lit(None).cast("string")
    groups = [vendors.select("doc_id", "user_id", "created_at", F.col("any_type").alias("t"), F.col("vendor").alias("v")),
              d.select("doc_id", "user_id", "created_at", F.col("any_type").alias("t"), none.alias("v")),
              vendors.select("doc_id", "user_id", "created_at", none.alias("t"), F.col("vendor").alias("v")),
              d.select("doc_id", "user_id", "created_at", none.alias("t"), none.alias("v"))]
    members = groups[0].union(groups[1]).union(groups[2]).union(groups[3])
    order = [F.col("created_at").desc(), F.col("doc_id").desc()]
    newest = top_per_key(members, ["user_id", "t", "v"], order, k + 1, "turn").groupBy("user_id", "t", "v").agg(
        F.sort_array(F.collect_list(F.struct("turn", "doc_id"))).alias("top"))
    newest = newest.select(F.col("user_id").alias("_u"), F.col("t").alias("_t"), F.col("v").alias("_v"), "top")
    same = F.col("user_id").eqNullSafe(F.col("_u")) & F.col("t").eqNullSafe(F.col("_t")) & F.col("v").eqNullSafe(F.col("_v"))
    others = F.slice(F.filter("top", lambda x: x["doc_id"] != F.col("doc_id")), 1, k)
    return asking.join(newest, same).select("doc_id", F.posexplode(others).alias("pos", "o")).select(
        "doc_id", (F.col("pos") + 1).alias("rank"), F.col("o.doc_id").alias("similar_id"))
