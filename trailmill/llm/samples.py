"""Bounded samples of labelled rows for the classifiers trained here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int,
                    keep: str | None = None) -> pd.DataFrame:
    """At most `per_class` rows (doc_id, text, label) of each class, on the driver.

    The rows with the least hash of doc_id are taken, so that the choice depends on neither order nor
    partitioning. Texts over `max_chars` characters are left out of training (never out of scoring): the
    sample has at most 2 * per_class * max_chars characters. `keep` is an SQL condition on doc_id.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    if keep:
        rows = rows.filter(keep)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [rows.filter(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * per_class rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    return texts.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).toPandas().sort_values("doc_id", ignore_index=True)
