"""Folds by checksum and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text, target`` of at most ``rows`` labelled rows outside the held-out fold, chosen by a hash of their id.

    The chosen label rows, whose number ``rows`` bounds, are broadcast; documents are read once and never move.
    """
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id), folds) != held_out))
        .select(F.col(doc_id).alias("labelled"), F.col(target).cast("int").alias("target"))
        .orderBy(F.xxhash64("labelled", F.lit(target)), "labelled", "target")
        .limit(rows)
    )
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.join(F.broadcast(chosen), slim["doc_id"] == chosen["labelled"]).select("text", "target")
