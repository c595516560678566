"""Quality by a factorisation machine over hashed words, structure statistics and the length, in linear time by the sum-of-squares identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import factorisation as fm
from tidefold.llm.common import fold

FEATURES = fm.Features(bits=20, prefixes=(), structure=True)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 16_000) -> fm.Machine:
    """Fitted on at most most_rows labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    sample = fm.labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label=[F.col(label_col)], train=fold(F.col("_id"), 4) != 2, most_rows=most_rows)
    return fm.fit(sample, FEATURES)


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 16_000) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted (1: good).

    Structure statistics (shares of distinct and repeated words, capitals, marks, digits, line ends; word length) and the
    length of the text as metadata come in buckets, each a bin of the machine like a word. Nulls, repeated rows, missing
    labels, extra columns and empty tables: as in toxicity.
    """
    machine = fit_quality(docs, labels, id_col=id_col, text_col=text_col, most_rows=most_rows)
    out = fm.scored(docs, machine, id_col=id_col, text_col=text_col)
    return out.select(id_col, (fold(F.col(id_col), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
