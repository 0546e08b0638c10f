"""Queries of reviewed records: integrity of their events, status by what supersedes, deprecates or outdates them, scores by field.

Tables: ``records`` (id, kind, status, title, claim, summary, source_refs: array of struct<path, kind, section, content_sha256>,
supersedes: array of ids, record_digest), ``events`` (id, type, record_id, superseded_by, record_digest, event_digest and
content_digest, the digest of what the event holds now), ``sources`` (path, content_sha256: the files as they are).
Null arrays are empty, null texts too; a record without sources is stale, as nothing vouches for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import lifecycle, retrieval, rules, textindex

# What an exact hit in each field weighs, a text match, and a reviewed record.
FIELDS = {"identity": 1.0, "title": 2.4, "claim": 2.0, "summary": 1.2, "source": 0.8}
TEXT, REVIEWED = 1.2, 0.5
SHOWN = ("reviewed", "stale", "superseded", "deprecated")

# Event types that name a record whose digest they keep, and those that name none.
OF_RECORD = ["approved", "deprecated", "refreshed_record_candidate"]
OF_NONE = ["rejected_candidate", "refreshed_candidate"]


def integrity_problems(events: DataFrame, records: DataFrame) -> DataFrame:
    """code, subject: what is wrong with events. One whose own digest is wrong isn't looked at further."""
    held = records.select(F.col("id").alias("record_id"), F.col("record_digest").alias("digest"), F.lit(True).alias("there"))
    other = held.select(F.col("record_id").alias("superseded_by"), F.col("digest").alias("new_digest"), F.col("there").alias("new_there"))
    rows = events.withColumns({"record_id": F.coalesce("record_id", F.lit("")), "superseded_by": F.coalesce("superseded_by", F.lit(""))})
    rows = rows.join(held, "record_id", "left").join(other, "superseded_by", "left")
    kind, same = F.col("type"), F.coalesce("record_digest", F.lit(""))
    subject = F.when(F.col("record_id") != "", F.col("record_id")).otherwise(F.col("id"))
    replacing = F.when(F.col("superseded_by") != "", F.col("superseded_by")).otherwise(F.col("id"))
    problem = lambda test, code, of: F.when(test, F.struct(F.lit(code).alias("code"), of.alias("subject")))
    missing = F.col("there").isNull()
    found = F.when(
        ~F.col("event_digest").eqNullSafe(F.col("content_digest")), F.array(problem(F.lit(True), "knowledge_event_digest_mismatch", F.col("id")))
    ).when(
        kind.isin(OF_RECORD),
        F.array(problem(missing, "knowledge_event_record_missing", subject), problem(~missing & (same != F.coalesce("digest", F.lit(""))), "knowledge_event_record_digest_mismatch", F.col("record_id"))),
    ).when(
        kind == "superseded",
        F.array(
            problem(missing, "knowledge_event_record_missing", subject),
            problem(F.col("new_there").isNull(), "knowledge_event_superseded_by_missing", replacing),
            problem(F.col("new_there") & (same != F.coalesce("new_digest", F.lit(""))), "knowledge_event_record_digest_mismatch", F.col("superseded_by")),
        ),
    ).when(~F.coalesce(kind.isin(OF_NONE), F.lit(False)), F.array(problem(F.lit(True), "knowledge_event_type_unknown", F.col("id"))))
    return rows.select(F.inline(F.array_compact(found)))


def supersession_problems(records: DataFrame) -> DataFrame:
    """code, subject: records that supersede themselves or what isn't there."""
    told = records.select("id", F.explode("supersedes").alias("old"))
    itself = told.filter("old = id").select(F.lit("knowledge_supersedes_self").alias("code"), F.col("id").alias("subject"))
    gone = told.filter("old <> ''").join(records.select(F.col("id").alias("old")), "old", "left_anti")
    return itself.unionByName(gone.select(F.lit("knowledge_supersedes_missing").alias("code"), F.col("old").alias("subject")))


def stale_ids(records: DataFrame, sources: DataFrame) -> DataFrame:
    """id of records with a source that is gone or changed, or without any."""
    refs = records.select("id", F.explode_outer("source_refs").alias("ref")).select("id", F.col("ref.path").alias("path"), F.coalesce("ref.content_sha256", F.lit("")).alias("digest"), F.col("ref").isNull().alias("none"))
    now = sources.select("path", F.col("content_sha256").alias("digest"))
    return refs.join(now, ["path", "digest"], "left_anti").select("id").distinct()


def with_status(records: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """``records``, their status derived: superseded, then deprecated, then stale, else as stored."""
    mark = lambda frame, name: frame.select(F.col("id"), F.lit(True).alias(name)).distinct()
    old = mark(records.select(F.explode("supersedes").alias("id")).filter("id <> ''"), "__superseded")
    gone = mark(events.filter("type = 'deprecated'").select(F.col("record_id").alias("id")), "__deprecated")
    stale = mark(stale_ids(records, sources), "__stale")
    rows = records.join(old, "id", "left").join(gone, "id", "left").join(stale, "id", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    status = lifecycle.status_for_query(flag("__superseded"), flag("__deprecated"), flag("__stale"), F.coalesce("status", F.lit("")))
    return rows.withColumn("derived", status).drop("__superseded", "__deprecated", "__stale")


def status_report(rows: DataFrame, hidden: list[str]) -> DataFrame:
    """status, available, excluded: how many records have each status, and how many of these a query leaves out."""
    return rows.groupBy(F.col("derived").alias("status")).agg(F.count(F.lit(1)).alias("available"), F.count_if(F.col("derived").isin(hidden)).alias("excluded"))


def terms(question: Column) -> Column:
    return F.array_sort(t.query_terms(question, rules.KNOWLEDGE_STOPWORDS))


def _bodies(rows: DataFrame) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = F.coalesce(F.to_json("source_refs"), F.lit("[]"))
    fields = {"identity": F.concat_ws("\n", told("id"), told("kind")), "title": told("title"), "claim": told("claim"), "summary": told("summary"), "source": source}
    return rows.select("id", "derived", "status", *[v.alias(k) for k, v in fields.items()])


def scores(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """q, id, derived, score and its parts for records with a derived status and ``questions`` (q, question; few)."""
    asked = questions.select("q", terms(F.col("question")).alias("terms"))
    body = _bodies(rows)
    index = textindex.build(body.select("id", F.concat_ws("\n", *FIELDS).alias("body")), "id", ["body"], "body")
    fts = textindex.alone(index, asked).withColumnRenamed("doc", "id")
    share = lambda c: F.expr(f"size(filter(terms, x -> contains(lower({c}), lower(x)))) / greatest(1, size(terms))")
    met = body.join(retrieval.small(asked), how="cross")  # the stated questions beside every record: reviewed ones all score
    exact = met.select("q", "id", "derived", F.when(F.col("status") == "reviewed", REVIEWED).otherwise(0.0).alias("authority"), *[share(c).alias(f"exact_{c}") for c in FIELDS])
    both = exact.join(fts, ["q", "id"], "left").withColumn("fts", F.coalesce("fts", F.lit(0.0)))
    total = sum((F.col(f"exact_{c}") * w for c, w in FIELDS.items()), F.col("fts") * TEXT + F.col("authority"))
    return both.withColumn("score", F.round(total, 6)).filter("score > 0")


def query(records: DataFrame, events: DataFrame, sources: DataFrame, questions: DataFrame, limit: int = 10, include: tuple[str, ...] = ()) -> DataFrame:
    """q, rank, id, status, score: each question's best records, ties to the smaller id.

    Stale, superseded and deprecated ones only where ``include`` has their status. A negative limit leaves out so many of the last.
    """
    rows = with_status(records, events, sources).filter(F.col("derived").isin([x for x in SHOWN if x == "reviewed" or x in include]))
    found = scores(rows, questions)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    if limit >= 0:
        ranked = ranked.filter(F.col("rank") <= limit)
    else:
        count = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
        ranked = ranked.join(F.broadcast(count), "q").filter(F.col("rank") <= F.col("n") + limit)
    return ranked.select("q", "rank", "id", F.col("derived").alias("status"), "score")
