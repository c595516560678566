"""What the text operators share: folds, scratch tables in the shared folder, and word arrays for Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all operators here, as a character class body.
BLANKS = r"\x20\x09-\x0D"
NOT_BLANK = rf"[^{BLANKS}]+"


def fold(col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % parts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. One is made only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="tidefold-"))
    return named.rstrip("/")


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and reread: lost executors don't lose it, and it isn't computed twice.

    The folder goes when the driver ends, or with clear_scratch.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_at_exit, spark)
    _written.append(path := f"{shared_folder(spark)}/tidefold-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a caller writes; they go as those of stored do."""
    if not _written:
        atexit.register(_at_exit, spark)
    _written.append(path := f"{shared_folder(spark)}/tidefold-{name}-{uuid.uuid4().hex}")
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that stored has written so far: for long sessions, once the results are used or written elsewhere."""
    while _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit(spark: SparkSession) -> None:
    try:
        clear_scratch(spark)
    except Exception:  # the session has ended, and scratch files are all that stays
        pass


#: Bytes of a batch that goes to a Python worker, where the session still has Spark's own bound of 64 MB.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of about BATCH_BYTES: what JVM and workers hold is then small whatever the texts. The bound is set in the session, which reads it when a plan runs."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key) in ("67108864b", "64MB", "64m"):
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


# --- rows of documents ------------------------------------------------------------------------------------------------

#: Keys with at least 1/HOT of all rows, of which there are at most HOT, are broadcast; so none of the others is large.
HOT = 10_000


def looked_up(left: DataFrame, right: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """left (rows rows) with the columns of right, null where there is no such key: a left join that a hot key doesn't overload.

    right has a row for each key and in size how many rows of left have it; both are read several times, so they should
    be stored. Keys of at least rows / HOT rows (at most HOT of them, and two or more rows each) are broadcast, all others
    shuffled.
    """
    least = max(rows / HOT, 2)
    hot, cold = F.broadcast(right.where(F.col(size) >= least)), right.where(F.col(size) < least)
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(cold, key, "left"), allowMissingColumns=True)


def digest(text: Column) -> Column:
    """96 bits of hash of a text as it is; null as the empty text. With the id it names a row of documents, but for rows equal in both."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.hash(whole).alias("b"))


#: Up to so many dropped rows (36 bytes each) are broadcast; beyond it the rows that stay are shuffled once.
MOST_SENT = 2_000_000


def kept_rows(docs: DataFrame, found: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, without the rows that found drops. found has one row for each row of docs: _id, _digest, _kept.

    Rows are told by id and text, so a null or repeated id costs no other text its row. Of rows equal in both as many as
    found keeps stay: none, all, or, where found keeps some, one. Texts aren't shuffled while at most MOST_SENT rows go.
    """
    counts = found.groupBy("_id", "_digest").agg(F.sum(F.col("_kept").cast("int")).alias("_k"), F.count("*").alias("_n")).where("_k < _n")
    counts = stored(counts.select(F.col("_id").alias("_drop_id"), F.col("_digest").alias("_drop_digest"), (F.col("_k") > 0).alias("_drop_one")), "dropped")
    same = docs[id_col].eqNullSafe(F.col("_drop_id")) & (digest(docs[text_col]) == F.col("_drop_digest"))
    left = docs.join(F.broadcast(counts) if counts.count() <= MOST_SENT else counts, same, "left_anti")
    twins = counts.where("_drop_one")
    if twins.isEmpty():
        return left
    # Equal rows: partial aggregation leaves one of each in every task before anything is shuffled.
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_twin_id"), digest(F.col(text_col)).alias("_twin_digest"))
    one = one.join(twins, F.col("_twin_id").eqNullSafe(F.col("_drop_id")) & (F.col("_twin_digest") == F.col("_drop_digest")), "left_semi")
    return left.unionByName(one.groupBy("_twin_id", "_twin_digest").agg(F.first("_row").alias("_row")).select("_row.*"))


# --- words of Arrow batches -------------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
#: Bytes whose prefix sums are held at once, and up to which powers are kept between calls.
BLOCK = 1 << 19
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n at least."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, BLOCK + 1)
    tables = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 2**64)))
    if size == BLOCK + 1:
        _powers = tables
    return tables


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _table(in_word) -> np.ndarray:
    return np.array([bool(in_word(b)) for b in range(256)])


#: Bytes in words: all but blanks; or ASCII letters, digits and all of longer code points.
NON_BLANK_BYTES = _table(lambda b: b != 32 and not 9 <= b <= 13)
ALNUM_BYTES = _table(lambda b: b >= 128 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """The words of a run of texts: data (all bytes), starts and ends (of words, in data), doc (row of each word), first (each row's first word, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(offsets) - 1
        inside = in_word[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[:1], before[1:], after[-1:], after[:-1] = False, inside[:-1], False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end], starts ascending; equal bytes, equal hashes. Takes the memory of a block or of the longest word, not of the text."""
        out, a = np.empty(len(starts), np.uint64), 0
        while a < len(starts):
            base = int(starts[a])
            b = max(a + 1, int(np.searchsorted(starts, base + BLOCK // 2)))
            stop = int(ends[a:b].max())
            up, down = _power_tables(stop - base + 1)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(_BYTE[self.data[base:stop]] * up[: stop - base], dtype=np.uint64, out=sums[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
        return out

    def hashes(self) -> np.ndarray:
        return self.hashed(self.starts, self.ends)


def text_runs(texts: pa.Array, run_bytes: int = 1 << 18):
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about run_bytes; null counts as empty. Nothing is copied."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + run_bytes, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def released(batches):
    """The same batches; after the last, the worker gives the memory that its allocators kept back to the machine, as it may stay idle for long."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def doc_sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)
