"""Uploaded files as rows of a table, with ids that follow those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import gapless
from .files import split_uploads, stored_name
from .shared import exists

SCHEMA = "id long, filename string, stored string, status string"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], SCHEMA)


def insert_uploads(spark: SparkSession, folder: str, files: DataFrame, order: tuple[str, ...] = ("filename",), start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Append the accepted rows of ``files (filename, mime_type, …)``; ``(inserted, refused)``.

    Ids run without gaps from the table's largest (``start`` in an empty table), by
    ``order`` and then by the other columns, whatever the number of tasks. ``inserted`` has all columns of
    ``files`` beside ``id`` and ``stored``, the name that the file is kept under.
    """
    accepted, refused = split_uploads(files)
    top = uploads(spark, folder).agg(F.max("id").alias("top")).first()["top"]
    numbered = gapless(accepted, list(order), start if top is None else max(start, top))
    inserted = numbered.withColumns({"stored": stored_name(F.col("id"), F.col("filename")), "status": F.lit("Uploaded")})
    inserted.select("id", "filename", "stored", "status").write.mode("append").parquet(folder)
    return inserted, refused
