"""Changes to snapshots: inserts, partial updates, deletes with cascade, new columns.

Plain Parquet has no MERGE, so each takes a snapshot and a change frame and
returns the next snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import trimmed_or_null
from ..settings import WORKFLOW_STATUSES


def get_or_create(snapshot: DataFrame, pairs: DataFrame, keys=("resume_id", "jd_id")) -> DataFrame:
    """Pairs that the snapshot lacks, once each."""
    return pairs.dropDuplicates(list(keys)).join(snapshot, list(keys), "left_anti")


def latest_notes(changes: DataFrame) -> DataFrame:
    """The notes after a change log ``(note_id, seq, op, text, author, at)``.

    Updates carry only what they change; blank texts are ignored; a note whose
    last change is a delete is gone.
    """
    log = changes.withColumns({"text": trimmed_or_null(F.col("text")), "author": trimmed_or_null(F.col("author"))})
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    out = log.groupBy("note_id").agg(last("text"), last("author"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max_by("op", "seq").alias("op"))
    return out.where("op <> 'delete'").drop("op")


def valid_notes(notes: DataFrame, analyses: DataFrame) -> DataFrame:
    """Notes of 1 to 5000 characters by authors of 1 to 255 whose analysis exists."""
    ok = F.length(F.trim("text")).between(1, 5000) & F.length(F.trim("author")).between(1, 255)
    return notes.where(ok).join(analyses.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")


def newest_notes(notes: DataFrame) -> DataFrame:
    return notes.orderBy(F.desc("created_at"), F.desc("id"))


def update_status(analyses: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes (id, workflow_status, seq)``: the last valid one of each id applies, of equal places the later name."""
    valid = changes.where(F.col("workflow_status").isin(*WORKFLOW_STATUSES)).groupBy("id").agg(F.max(F.struct("seq", "workflow_status"))["workflow_status"].alias("new_status"))
    return analyses.join(valid, "id", "left").withColumn("workflow_status", F.coalesce("new_status", "workflow_status")).drop("new_status")


def delete_analyses(analyses: DataFrame, notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of analyses and of their notes once ``ids (id)`` are deleted."""
    return analyses.join(ids, "id", "left_anti"), notes.join(ids.select(F.col("id").alias("analysis_id")), "analysis_id", "left_anti")


def with_columns_added(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns are added as nulls; running it again changes nothing."""
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in rows.columns})


def union_evolving(*versions: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)


def stale_sources(sources: DataFrame, index: DataFrame) -> DataFrame:
    """Sources ``(resume_id, sha)`` without an index made from the same content; an index
    without a recorded fingerprint is not valid."""
    return sources.join(index.where("sha IS NOT NULL").select("resume_id", "sha"), ["resume_id", "sha"], "left_anti")


def dedupe_in_order(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key, at its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def first_occurrences(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.where("__n = 1").drop("__n")
