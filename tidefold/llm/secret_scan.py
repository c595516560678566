"""Secret scan: pattern spans in every text, and corpus-wide ownership of each secret to tell live ones from copied examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import looked_up, stored

_KEY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RUN = "A-Za-z0-9+/_=-"
#: kind, pattern, group that is the secret, its least length. A maximal run of 20 or more with a digit and a letter is a loose candidate.
BASE_KINDS = (("assign", _KEY, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))
LOOSE = ("owned", rf"(?<![{_RUN}])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[{_RUN}]{{20,}}", 0, 20)

_SPAN = "struct<start:int,rank:int,end:int,secret:string>"
#: Elements of an array that running takes at a time.
_CHUNK = 256


def running(values: Column, merge: Callable[[Column, Column], Column], start: int) -> Column:
    """The running merge (a sum, say) of an array of integers, itself included.

    Appending to an array copies it, so chunks are taken one by one and then shifted by what came before them: the work
    is a small multiple of the array's length.
    """

    def within(part: Column) -> Column:
        begin = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = merge(acc["at"], x).cast("int")
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda i: within(F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK))))
    tops = F.transform(chunks, lambda c: F.element_at(c, -1))
    before = F.concat(F.array(F.lit(start)), within(F.slice(tops, F.lit(1), F.size(tops) - 1)))
    return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c, lambda x: merge(x, b).cast("int"))))


def _with_spans(df: DataFrame, name: str, rank: int, pattern: str, group: int, least: int) -> DataFrame:
    """df (_text, more) with the spans of the leftmost matches that don't overlap, from the pieces between them; matches with too short a secret drop out."""
    text = F.col("_text")
    hit = df.withColumn("_whole", F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    # Of each piece of text and the match behind it, the length.
    gaps = F.when(F.col("_whole").isNotNull(), F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_whole")))
    sized = hit.withColumn("_steps", F.zip_with(gaps, "_whole", lambda g, w: F.length(g) + F.length(w)))
    ended = sized.withColumn("_ends", F.when(F.size("_steps") > 0, running(F.col("_steps"), lambda a, b: a + b, 0)))

    def span(w: Column, end: Column) -> Column:
        secret = F.regexp_extract(w, pattern, group) if group else w
        return F.struct((end - F.length(w)).cast("int").alias("start"), F.lit(rank).alias("rank"), end.alias("end"), secret.alias("secret"))

    found = F.filter(F.zip_with("_whole", "_ends", span), lambda s: F.length(s["secret"]) >= least)
    return ended.withColumn(name, F.coalesce(found, F.array()).cast(f"array<{_SPAN}>")).drop("_whole", "_steps", "_ends")


def _with_apart(df: DataFrame) -> DataFrame:
    """df (_all: spans sorted by start and rank) with _apart: for each span, whether it is a base one or touches none of them; null where there is no span."""
    base = len(BASE_KINDS)
    far = 2**31 - 1
    some = F.size("_all") > 0
    # Columns of their own, as running reads its array for every chunk.
    ends = F.transform("_all", lambda s: F.when(s["rank"] < base, s["end"]).otherwise(0))
    starts = F.reverse(F.transform("_all", lambda s: F.when(s["rank"] < base, s["start"]).otherwise(far)))
    df = df.withColumn("_ends", F.when(some, ends)).withColumn("_starts", F.when(some, starts))
    df = df.withColumn("_reached", F.when(some, running(F.col("_ends"), F.greatest, 0))).withColumn("_ahead", F.when(some, F.reverse(running(F.col("_starts"), F.least, far))))
    clear = F.zip_with("_reached", "_ahead", lambda r, a: F.struct(r.alias("reached"), a.alias("ahead")))
    apart = F.zip_with("_all", clear, lambda s, x: (s["rank"] < base) | ((x["reached"] <= s["start"]) & (x["ahead"] >= s["end"])))
    return df.withColumn("_apart", F.when(some, apart)).drop("_ends", "_starts", "_reached", "_ahead")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*BASE_KINDS, LOOSE)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository_col: str | None = None, owner_col: str = "source", most_owners: int = 2, most_repositories: int = 25, most_share: float = 0.01) -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied.

    Candidates are the secrets of base patterns and loose ones: runs of 20 or more key characters with digit and letter
    that touch no base span. Their hashes are counted over the whole corpus by distinct repositories (the row's id where
    no column is named) and owners. A candidate is a copied example with more than most_owners owners, or in more
    repositories than most_repositories and than most_share of the corpus's rows; any other is live-looking. Live-looking
    loose candidates are added as spans of kind "owned". n_live and n_copied count base and loose candidates of the row
    by that verdict.

    Null texts are empty: no spans, the hash of the empty text. Null owners count as one owner, and so do null
    repositories. Every row keeps its own spans, whatever its id: null and repeated ids don't mix. No rows: no rows. Only
    hashes of candidates are shuffled; those of very frequent ones are looked up by broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repository = F.coalesce((F.col(repository_col) if repository_col else F.col(id_col)).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), repository.alias("_repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"), text.alias("_text"))
    for i, kind in enumerate((*BASE_KINDS, LOOSE)):
        base = _with_spans(base, f"_k{i}", i, *kind[1:])
    counts = [F.size(F.col(f"_k{i}")).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(BASE_KINDS)]
    base = base.select("_id", "_repo", "_owner", *counts, F.array_sort(F.concat("_k0", "_k1", "_k2")).alias("_sure"), "_k3")
    base = base.withColumn("_all", F.when(F.size("_k3") == 0, F.col("_sure")).otherwise(F.array_sort(F.concat("_sure", "_k3"))))
    base = _with_apart(base)
    left = F.when(F.col("_apart").isNull(), F.col("_all")).otherwise(F.transform(F.filter(F.arrays_zip(F.col("_all").alias("s"), F.col("_apart").alias("ok")), lambda x: x["ok"]), lambda x: x["s"]))
    hashed = F.transform(left, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.xxhash64(s["secret"]).alias("hash")))
    sums = [F.col(f"n_{k[0]}") for k in BASE_KINDS]
    rows = stored(base.select(F.monotonically_increasing_id().alias("_row"), "_id", "_repo", "_owner", *sums, F.sha2(_joined(F.col("_sure")), 256).alias("base_sha256"), hashed.alias("_spans")), "secrets")

    found = stored(rows.where(F.size("_spans") > 0).select("_row", "_repo", "_owner", F.posexplode("_spans").alias("_n", "_s")).select("_row", "_repo", "_owner", "_n", F.col("_s.hash").alias("_h")), "candidates")
    # By owner and repository first, so a secret that is everywhere is counted from partial counts.
    seen = found.groupBy("_h", "_owner", "_repo").agg(F.count("*").alias("_times"))
    by_owner = seen.groupBy("_h", "_owner").agg(F.count("*").alias("_repos"), F.sum("_times").alias("_times"))
    owners = by_owner.groupBy("_h").agg(F.count("*").alias("_owners"), F.sum("_repos").alias("_repos"), F.sum("_times").alias("_times"))
    everywhere = max(float(most_repositories), most_share * rows.count())
    verdicts = stored(owners.select("_h", "_times", ((F.col("_owners") <= most_owners) & (F.col("_repos") <= everywhere)).alias("_live")), "verdicts")
    # A row's verdicts are as many as its own candidates.
    judged = looked_up(found.select("_row", "_n", "_h"), verdicts, "_h", "_times", found.count())
    judged = judged.groupBy(F.col("_row").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_n", "_live"))).alias("_verdicts"))
    out = rows.join(judged, F.col("_row") == F.col("_of"), "left")
    whole = F.zip_with("_spans", "_verdicts", lambda s, v: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), v["_live"].alias("live")))
    out = out.withColumn("_judged", F.coalesce(F.when(F.size("_spans") > 0, whole), F.array().cast("array<struct<start:int,rank:int,end:int,live:boolean>>")))
    kept = F.filter("_judged", lambda s: (s["rank"] < len(BASE_KINDS)) | s["live"])
    return out.select(
        F.col("_id").alias(id_col), *[f"n_{k[0]}" for k in BASE_KINDS], "base_sha256", _joined(kept).alias("spans"),
        F.size(F.filter(kept, lambda s: s["rank"] == len(BASE_KINDS))).cast("long").alias("n_owned"),
        F.size(F.filter("_judged", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("_judged", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
