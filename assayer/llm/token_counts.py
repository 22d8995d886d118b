"""Exact histogram of encoded lengths, with what every context limit would keep.

Tasks encode whole texts and only count the ids; Spark counts documents by
length. Running sums then go over the distinct lengths alone. Distinct lengths
add up to no more than all tokens, so of N tokens there are at most sqrt(2 N)
and one: 10 billion tokens have under 142,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import piece_encoder
from .workspace import ship


def token_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``(n_tokens long)`` per row: the ids of the whole text without special tokens; null and blank texts have 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder.lengths(batch.column(0)), pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens)`` rows -> one row per distinct length.

    ``documents`` have this length, ``documents_up_to`` this or a smaller one;
    ``documents_at_least`` and ``tokens_at_least`` are suffix sums.
    ``truncated_tokens`` is what is left of all tokens at a context limit of
    ``n_tokens``. For any limit L, the row of the smallest length of L or more
    gives ``truncated_tokens - (n_tokens - L) * documents_at_least``; beyond the
    largest length all tokens are kept. ``percentiles`` are those of 0 to 100
    that fall on this length by nearest rank (rank ceil(p * documents / 100), 1
    at least). No rows give none.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))
    every = Window.partitionBy(F.lit(0)).orderBy("n_tokens")
    up, down = every.rowsBetween(Window.unboundedPreceding, 0), every.rowsBetween(0, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("documents")
    sums = counts.select(
        "n_tokens", "documents", F.sum("documents").over(up).alias("documents_up_to"), F.sum("documents").over(down).alias("documents_at_least"),
        F.sum(tokens).over(up).alias("tokens_up_to"), F.sum(tokens).over(down).alias("tokens_at_least"),
    )
    total, before = F.expr("documents_up_to + documents_at_least - documents"), F.expr("documents_up_to - documents")
    rank = lambda p: F.greatest(F.lit(1), F.ceil((p * total) / 100))
    return sums.select(
        "n_tokens", "documents", "documents_up_to", "documents_at_least", "tokens_at_least",
        F.expr("tokens_up_to + n_tokens * (documents_at_least - documents)").alias("truncated_tokens"),
        F.filter(F.sequence(F.lit(0), F.lit(100)), lambda p: (rank(p) > before) & (rank(p) <= F.col("documents_up_to"))).alias("percentiles"),
    )


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``histogram`` of the rows' encoded lengths. Repeated rows each count; very long texts are encoded whole; other
    columns are ignored, whatever their names."""
    return histogram(token_lengths(docs, tokenizer_path, text_col))
