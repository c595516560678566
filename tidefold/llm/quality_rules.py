"""Quality rules whose cutoffs adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import BLANKS, stored

#: One word of the shortest text that the base rules let pass: the least quartile distance, which only breaks ties.
TIE = 1 / 50
#: metric, whether low values fail too, whether quartiles are those of the non-zero part: lines and words come twice in good texts as well, so that rare repeats alone say nothing.
METRICS = (("symbol_ratio", False, False), ("dup_line_ratio", False, True), ("repeat_ratio", False, True), ("word_length", True, False))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, by built-in functions within each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    first = docs.withColumn("_words", F.array_remove(F.split(text, f"[{BLANKS}]+", -1), "")).withColumn("_lines", lines)
    grams = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    second = first.withColumn("_grams", F.when(F.size("_words") >= 4, grams))
    # Only where a window comes twice: hashes sorted with their places, equal neighbours kept, and the words that they cover counted once.
    placed = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.arrays_zip(F.col("_grams").alias("h"), F.sequence(F.lit(0), F.size("_grams") - 1).alias("p"))))
    third = second.withColumn("_placed", placed)
    twin = F.zip_with(F.slice("_placed", 1, F.size("_placed") - 1), F.slice("_placed", 2, F.size("_placed") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    fourth = third.withColumn("_twins", F.array_distinct(F.flatten(F.array_compact(twin))))
    covered = F.size(F.array_distinct(F.concat("_twins", F.transform("_twins", lambda p: p + 1), F.transform("_twins", lambda p: p + 2))))
    return fourth.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"[{BLANKS}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twins").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
    )


def ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fences: float = 3.0, least_rows: int = 200, sketch_size: int = 4096, salts: int = 64) -> DataFrame:
    """One row for each row of docs: id, the five statistics, base_failed, the four ratios, n_outside and kept.

    The quartiles of each ratio come from mergeable quantile sketches (KLL, of sketch_size; exact up to about as many
    values) of each language and source, of each language and of everything, over rows that the base rules let pass.
    Those of dup_line_ratio and repeat_ratio are of the rows where they aren't 0. A group of fewer than least_rows such
    rows, or of fewer than a quarter of that where the ratio isn't 0, takes the next wider one. A ratio above the upper
    quartile by more than fences times the quartile distance (at least TIE) is outside; for word length below the lower
    quartile too. kept: base_failed is false and nothing is outside.

    Null and empty texts have no words: base_failed, not kept. Null languages and sources are groups of their own. Each
    group is sketched in salts parts, so that a hot one isn't one task's; the cutoffs are joined from at most one row for
    each language and source. Repeated rows and ids are judged each. No rows: no rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    stats = with_statistics(base, "_text").drop("_text")
    stats = stored(
        stats.select(
            *stats.columns,
            (F.col("n_symbols") / F.greatest("n_words", F.lit(1))).alias("symbol_ratio"),
            ratio("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
            ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
            ratio("word_chars", "n_words").alias("word_length"),
            ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        ),
        "rules",
    )
    ratios = [(m, F.when(~F.col("base_failed") & ((F.col(m) > 0) | F.lit(not part)), F.col(m))) for m, _, part in METRICS]
    size = F.lit(sketch_size)
    # A part of a group for every salt; the parts of a group, the groups of a language, the languages.
    parts = stats.groupBy("_lang", "_source", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")).agg(F.count(F.when(~F.col("base_failed"), 1)).alias("_n"), *[F.kll_sketch_agg_double(v, size).alias(f"_s_{m}") for m, v in ratios])
    merged = [F.sum("_n").alias("_n"), *[F.kll_merge_agg_double(f"_s_{m}", size).alias(f"_s_{m}") for m, _, _ in METRICS]]
    own = stored(stored(parts, "rules-parts").groupBy("_lang", "_source").agg(*merged), "rules-groups")
    wide = stored(own.groupBy("_lang").agg(*merged), "rules-languages")

    def with_quartiles(df: DataFrame) -> DataFrame:
        n = [F.kll_sketch_get_n_double(f"_s_{m}").alias(f"_n_{m}") for m, _, _ in METRICS]
        q = [F.when(F.col(f"_n_{m}") > 0, F.kll_sketch_get_quantile_double(f"_s_{m}", F.array(F.lit(0.25), F.lit(0.75)))).alias(f"_q_{m}") for m, _, _ in METRICS]
        return df.select("*", *n).select("*", *q)

    def quartiles(name: str) -> Column:
        enough = [F.when((F.col("_n") >= least_rows) & (F.col(f"_n_{m}") >= (least_rows / 4 if part else least_rows)), F.col(f"_q_{m}")).alias(m) for m, _, part in METRICS]
        return F.struct(*enough).alias(name)

    # The one row of everything: a few numbers. Where no row has a value, as good as 0.
    top = with_quartiles(wide.agg(*merged)).select(*[f"_q_{m}" for m, _, _ in METRICS]).first()
    own = with_quartiles(own).select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), quartiles("_own"))
    wide = with_quartiles(wide).select(F.col("_lang").alias("_wl"), quartiles("_wide"))
    every = {m: F.array(*[F.lit(float(v)) for v in q or (0.0, 0.0)]) for (m, _, _), q in zip(METRICS, top or [None] * len(METRICS), strict=True)}
    cuts = own.join(wide, F.col("_l").eqNullSafe(F.col("_wl")), "left").select("_l", "_s", F.struct(*[F.coalesce(f"_own.{m}", f"_wide.{m}", every[m]).alias(m) for m, _, _ in METRICS]).alias("_cut"))
    judged = stats.join(cuts, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    outside = F.lit(0)
    for name, low_too, _ in METRICS:
        q25, q75 = F.col(f"_cut.{name}")[0], F.col(f"_cut.{name}")[1]
        reach = fences * F.greatest(q75 - q25, F.lit(TIE))
        fails = F.col(name) > q75 + reach
        outside = outside + F.when(fails | (F.col(name) < q25 - reach) if low_too else fails, 1).otherwise(0)
    judged = judged.withColumn("n_outside", outside)
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_outside") == 0)).alias("kept"),
        *[m for m, _, _ in METRICS], F.col("n_outside").cast("long").alias("n_outside"),
    )
