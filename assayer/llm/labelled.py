"""Bounded, reproducible samples of labelled documents, and hashed folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id, which so is neither learned from nor held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text binary, label int, weight double)``: at most ``per_class`` labelled documents of each class.

    Documents are taken whole, in the order of a hash of their id, among those for
    which ``learn`` holds (a predicate on ``id``), as long as all together hold
    ``most_bytes`` at most; one that doesn't fit any more is passed over. Contradicting
    labels of an id count as 1, and of texts that share an id the largest is taken.
    ``weight`` restores the classes' shares among all learnable labels. At most
    ``2 * per_class`` ids are broadcast to find their texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label")).where(learn)
    known = materialise(known, "labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for value in (0, 1):
        n = counts.get(value, 0)
        weight = F.lit(max(1.0, n / per_class))
        parts.append(known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class).withColumn("weight", weight))
    chosen = materialise(reduce(DataFrame.union, parts), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    sizes = texts.join(F.broadcast(chosen.select("id")), "id").groupBy("id").agg(F.max(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("id"), "id")
    fitting, room = [], most_bytes
    for r in sizes.collect():
        if r["size"] <= room:
            fitting.append((r["id"],))
            room -= r["size"]
    fit = labels.sparkSession.createDataFrame(fitting, known.select("id").schema)
    found = texts.join(F.broadcast(chosen.join(fit, "id")), "id").where(F.octet_length("text") <= most_bytes)
    return materialise(found.groupBy("id", "label", "weight").agg(F.max("text").alias("text")).select("id", "text", "label", "weight"), "sample")
