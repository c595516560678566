"""Toxicity by a factorisation machine over hashed terms, which learns pairs of terms besides single ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import factorisation as fm
from tidefold.llm.common import fold

FEATURES = fm.Features(bits=20, prefixes=(4, 5))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 16_000) -> fm.Machine:
    """Fitted on at most most_rows labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    sample = fm.labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label=[F.col(label_col)], train=fold(F.col("_id"), 4) != 2, most_rows=most_rows)
    return fm.fit(sample, FEATURES)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 16_000) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted.

    Terms are words in lower case and their first 4 and 5 bytes, so that inflected and compound insults are seen. Null
    labels and ids are not learned from; null and empty texts are scored by the bias alone; repeated rows are scored
    each; without labels every score is 0.5. Extra columns are not read. No rows: no rows.
    """
    machine = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, most_rows=most_rows)
    out = fm.scored(docs, machine, id_col=id_col, text_col=text_col)
    return out.select(id_col, (fold(F.col(id_col), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without what scores threshold or more. Nothing is shuffled but the labelled sample.

    Each row is judged by its own text, so null and repeated ids and equal rows don't matter. Null and empty texts score
    by the bias alone, below any useful threshold. Without labels all score 0.5. No rows: no rows.
    """
    return fm.below(docs, fit_toxicity(docs, labels, text_col=text_col, **options), threshold, text_col=text_col)
