"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm import common
from tidefold.llm.common import BLANKS, kept_rows, looked_up, stored


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " ")


def _judged(docs: DataFrame, *, id_col: str, text_col: str, prefix_chars: int, broadcast_keys: int, digest: bool) -> DataFrame:
    """(_id, _digest, _keep, _size, _kept, _full) for each row of docs; _digest: of the text as it is, _full: sha2 of the normalised one, without digest only where others share length and prefix."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("_id"), common.digest(text).alias("_digest"), normalised(text).alias("_norm"))
    keyed = base.select("_id", "_digest", "_norm", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix"))
    whole = F.sha2(F.col("_norm"), 256)
    if digest:
        # Every text's hash is asked for, so one scan gives the keys of all three steps.
        rows = stored(keyed.select("_id", "_digest", "_len", "_prefix", whole.alias("_full"), F.monotonically_increasing_id().alias("_row")), "dedup-rows")
        keys = rows.groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    else:
        keys = keyed.groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    keys = stored(keys, "dedup-keys")
    same_length = keys.groupBy("_len").agg(F.sum("_n").alias("_all")).where("_all > 1").select("_len")
    alive = keys.where("_n > 1").join(same_length, "_len", "left_semi").select(F.col("_len").alias("_l"), F.col("_prefix").alias("_p"))
    survives = F.col("_l").isNotNull()
    found = (F.col("_len") == F.col("_l")) & (F.col("_prefix") == F.col("_p"))
    # Within the bound the keys are sent to every task; beyond it rows and keys meet by a shuffle.
    few = alive.limit(broadcast_keys + 1).count() <= broadcast_keys
    alive = F.broadcast(alive) if few else alive
    if digest:
        rows = rows.join(alive, found, "left").select("_id", "_digest", "_row", "_full", survives.alias("_survives"))
    elif few:
        rows = stored(keyed.join(alive, found, "left").select("_id", "_digest", F.when(survives, whole).alias("_full"), survives.alias("_survives"), F.monotonically_increasing_id().alias("_row")), "dedup-rows")
    else:
        # Survivors are told by short keys, but to find them again rows are joined by id and digest, and their texts are shuffled with them.
        slim = stored(keyed.select("_id", "_digest", "_len", "_prefix").join(alive, found, "left").groupBy("_id", "_digest").agg(F.max(survives).alias("_survives")).withColumnsRenamed({"_id": "_sid", "_digest": "_sd"}), "dedup-survivors")
        again = keyed.join(slim, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_digest") == F.col("_sd")))
        rows = stored(again.select("_id", "_digest", F.when(F.col("_survives"), whole).alias("_full"), "_survives", F.monotonically_increasing_id().alias("_row")), "dedup-rows")
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = stored(rows.where("_survives").groupBy(F.col("_full").alias("_g")).agg(first.alias("_first"), F.count("*").alias("_size")).where("_size > 1"), "dedup-groups")
    total = keys.agg(F.sum("_n")).first()[0] or 0
    out = looked_up(rows.withColumn("_g", F.when(F.col("_survives"), F.col("_full"))), groups, "_g", "_size", total)
    alone = F.col("_first").isNull()
    return out.select("_id", "_digest", F.when(alone, F.col("_id")).otherwise(F.col("_first.id")).alias("_keep"), F.coalesce("_size", F.lit(1)).cast("long").alias("_size"), (alone | (F.col("_row") == F.col("_first.row"))).alias("_kept"), "_full")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_keys: int = 500_000, digest: bool = False) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, and with digest text_sha256 of every text.

    Rows are first grouped by length, groups of two or more by the hash of their first prefix_chars characters, and only
    what is left in groups of two or more is compared by the hash of the whole. Only these short keys are shuffled, not
    texts, but where more than broadcast_keys keys survive and no digest is asked for: then rows are joined with them by
    id and digest, and texts are shuffled along. Rows of
    large groups find their group by broadcast, rows of small ones by a shuffle.

    Null texts equal empty ones. The row with the smallest id stays; null ids come last, and of rows with the same id one
    stays, so no group keeps two. Other columns of docs, whatever their names, are not read. No rows: no rows.
    """
    found = _judged(docs, id_col=id_col, text_col=text_col, prefix_chars=prefix_chars, broadcast_keys=broadcast_keys, digest=digest)
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), *([F.col("_full").alias("text_sha256")] if digest else []))


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_keys: int = 500_000) -> DataFrame:
    """docs, all columns, one row of each group of equal texts: that with the smallest id.

    Rows go by their own text: null ids come last, of equal ids one row stays, and no unique text is lost to a row of the
    same id. No rows: no rows.
    """
    found = _judged(docs, id_col=id_col, text_col=text_col, prefix_chars=prefix_chars, broadcast_keys=broadcast_keys, digest=False)
    return kept_rows(docs, found.select("_id", "_digest", "_kept"), id_col=id_col, text_col=text_col)
