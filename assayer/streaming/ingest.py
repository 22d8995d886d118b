"""Documents that arrive in drops, indexed once per content; an extension beyond what the reference has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import fingerprint
from ..operators import dml
from ..sources.buckets import BucketTable
from ..sources.shared import quoted
from .events import apply_each, read_drop


def newest(documents: DataFrame, key: str, text: str, order: str | None = None) -> DataFrame:
    """The newest row of each ``key``, with its fingerprint ``sha``. Newest is the largest ``order``, of equals the larger
    text; without one the larger text counts. Columns must have an order; of rows alike in those the largest counts."""
    first = [*([order] if order else []), text]
    whole = F.struct(*quoted([*first, *(c for c in documents.columns if c not in first)]))  # each text is held once
    best = documents.groupBy(F.col(key).alias("__key")).agg(F.max(whole).alias("row")).select("row.*").select(*quoted(documents.columns))
    return best.withColumn("sha", fingerprint(F.coalesce(F.col(text), F.lit(""))))


def changed(latest: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``(key)`` of the documents ``(key, sha)`` where the index ``stored (key, sha)`` holds another content or none. No text is read."""
    shas = lambda x: x.select(F.col(key).alias("resume_id"), "sha")
    return dml.stale_sources(shas(latest), shas(stored).distinct()).where("resume_id IS NOT NULL").select(F.col("resume_id").alias(key))


def ingest_drops(spark: SparkSession, folder: str, schema, index: BucketTable, make: Callable[[DataFrame], DataFrame], checkpoint: str, text: str = "text", order: str | None = None, fmt: str = "parquet") -> None:
    """Bring ``index`` up to date with the files in ``folder`` that it hasn't seen, one batch per arrival.

    ``make`` turns documents ``(key, text, …, sha)`` into index rows, which carry ``sha``.
    Fingerprints are read from the buckets of the documents at hand. Documents whose content is indexed are passed over; the rows of all others are replaced, in their
    buckets alone. A batch that is repeated after a failure changes nothing, as it is known by its number.
    """

    def take(batch: DataFrame, number: int) -> None:
        latest = index.written(newest(batch, index.key, text, order), "newest")
        ids = index.written(changed(latest, index.of(latest.select(index.key)), index.key), "changed")
        index.once(number, make(latest.join(ids, index.key, "left_semi")), ids)

    apply_each(read_drop(spark, folder, schema, fmt), take, checkpoint).awaitTermination()
