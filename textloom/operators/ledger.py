"""The review ledger: append-only events on items, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decisions by event type; other types are no decisions. Items in these states are open.
DECISIONS = {"click": "approve", "view": "replace", "error": "escalate"}
OPEN = ("pending", "escalate")
MAX_LOG = 5000
# Longest reviewer's name and note.
MAX_REVIEWER, MAX_NOTE = 80, 2000


def decision(event_type: Column) -> Column:
    pairs = [x for k, v in DECISIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[event_type]


def latest_status(events: DataFrame, item: str = "user_id") -> DataFrame:
    """(item, status, event_id): the last decision on each item, pending without any. Partial aggregation keeps one row an
    item and task."""
    d = decision(F.col("event_type"))
    last = events.groupBy(item).agg(F.max(F.when(d.isNotNull(), F.struct("event_id", d.alias("d")))).alias("l"))
    return last.select(item, F.coalesce("l.d", F.lit("pending")).alias("status"), F.col("l.event_id").alias("event_id"))


def status_counts(events: DataFrame, item: str = "user_id") -> DataFrame:
    return latest_status(events, item).groupBy("status", F.col("status").isin(*OPEN).alias("is_open")).agg(F.count(F.lit(1)).alias("n"))


def audit_log(events: DataFrame, items: DataFrame, on: Column, columns: list[str], most: int) -> DataFrame:
    """Decisions with their items, newest first, at most min(most, MAX_LOG)."""
    rows = events.withColumn("decision", decision(F.col("event_type"))).where("decision IS NOT NULL").join(items, on)
    return rows.orderBy(F.desc("event_id")).limit(max(1, min(most, MAX_LOG))).select(*columns)


def purged(checks: DataFrame, referred: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """The checks that stay: referred to, or not older than `days` before the newest."""
    cutoff = checks.agg((F.max(time) - F.expr(f"INTERVAL {days} DAYS")).alias("cutoff"))
    old = checks.join(F.broadcast(cutoff), F.col(time) < F.col("cutoff")).select(key)  # the cutoff is one row
    return checks.join(old.join(referred.select(key).distinct(), key, "left_anti"), key, "left_anti")


def enqueued(queue: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings to append: each key once, none that the queue has."""
    return findings.dropDuplicates(keys).join(queue.select(*keys), keys, "left_anti")


def violations(events: DataFrame, key: str, order: str, time: str, block: int = 100_000) -> DataFrame:
    """(event_id, fault): what an append-only log cannot hold: repeated keys, and times before that of an earlier row (by `order`, a
    number). Rows are compared within blocks of the order, whose largest times are carried over."""
    repeated = events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("event_id"), F.lit("repeated").alias("fault"))
    rows = events.withColumn("_block", F.floor(F.col(order) / block))
    latest = rows.groupBy("_block").agg(F.max(time).alias("_last"))  # a row a block
    carried = latest.select("_block", F.max("_last").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    earlier = Window.partitionBy("_block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    told = rows.join(carried, "_block").withColumn("_before", F.greatest(F.max(time).over(earlier), F.col("_carried")))
    return repeated.unionByName(told.where(F.col(time) < F.col("_before")).select(F.col(key).alias("event_id"), F.lit("time runs back").alias("fault")).distinct())


def payload(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as one JSON document."""
    return df.withColumn("payload", F.to_json(F.struct(*columns)))


def checked_decisions(new: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """new: (item, decision, reviewer, note, replacement). The rows with `code`: OK for those that may be appended, else the first reason
    against: BAD_DECISION, REVIEWER_REQUIRED, REVIEWER_TOO_LONG, NOTE_TOO_LONG, REPLACEMENT_REQUIRED, ITEM_NOT_FOUND."""
    known = items.select(item).distinct().withColumn("_known", F.lit(True))
    name, note = F.trim(F.coalesce("reviewer", F.lit(""))), F.trim(F.coalesce("note", F.lit("")))
    code = F.when(~F.coalesce(F.col("decision").isin(*DECISIONS.values()), F.lit(False)), "BAD_DECISION").when(name == "", "REVIEWER_REQUIRED")
    code = code.when(F.length(name) > MAX_REVIEWER, "REVIEWER_TOO_LONG").when(F.length(note) > MAX_NOTE, "NOTE_TOO_LONG")
    code = code.when((F.col("decision") == "replace") & (F.coalesce("replacement", F.lit("")) == ""), "REPLACEMENT_REQUIRED")
    code = code.when(F.col("_known").isNull(), "ITEM_NOT_FOUND").otherwise("OK")
    return new.join(known, item, "left").withColumn("code", code).drop("_known")


def check_records(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(check_id, text_sha256, verdict, payload): the record of a checked document to append: a digest in place of its text, and the
    counts as JSON."""
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).join(verdicts, "doc_id")
    check_id = F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "text_sha256")), 1, 16)
    return rows.select(check_id.alias("check_id"), "text_sha256", "verdict", F.to_json(F.struct("match", "near", "unattributed")).alias("payload"))


def exported(records: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """(key, translation_sha256, verdict, review): records for others to read: the digest under its public name, and the decisions on
    them in order, `event:decision`, comma-joined."""
    told = events.withColumn("decision", decision(F.col("event_type"))).where("decision IS NOT NULL")
    line = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "decision"))), lambda e: F.concat_ws(":", e["event_id"], e["decision"]))
    review = told.groupBy(key).agg(F.array_join(line, ",").alias("review"))
    return records.join(review, key, "left").select(key, F.col("text_sha256").alias("translation_sha256"), "verdict", F.coalesce("review", F.lit("")).alias("review"))
