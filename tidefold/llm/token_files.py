"""Token ids in files of compressed planes: blocks of ids, transposed into byte or bit planes, each plane compressed by zstandard, with an index of chunks.

A folder holds three Parquet tables, so that Spark's own writers commit them on any store and survive lost executors:
chunks (a row for each block: its place, the documents that begin in it, and its bytes), index (the same without the
bytes, with places in the whole corpus) and shards (where each task's ids begin). A chunk's bytes stand alone: a header
(magic, kind of planes, number of planes, ids, crc32 of the ids, size of each plane) and the planes.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import common
from tidefold.llm.common import in_arrow, released
from tidefold.llm.packing import Tokens

MAGIC = b"TFP1"
HEADER = struct.Struct("<4sBBII")
PLANES = {"byte": 0, "bit": 1}
#: Ids of a block, and how hard planes are compressed.
BLOCK, LEVEL = 65_536, 3
#: Bytes of whole texts that are encoded at once, and units that a process remembers: each unit of a run is looked at once.
RUN_BYTES, REMEMBERED = 4 << 20, 400_000


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    """One for a process, however many tasks it runs."""
    return Tokens(path, REMEMBERED)


@lru_cache(maxsize=8)
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@lru_cache(maxsize=1)
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def encoded(ids: np.ndarray, planes: str = "byte", level: int = LEVEL) -> bytes:
    """A block of ids below 2**32 as bytes: as many planes as the largest id needs."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if planes == "byte":
        rows = ids.view(np.uint8).reshape(-1, 4).T[: -(-bits // 8)]
        raw = [np.ascontiguousarray(r).tobytes() for r in rows]
    else:
        raw = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(bits)]
    packed = [_compressor(level).compress(r) for r in raw]
    head = HEADER.pack(MAGIC, PLANES[planes], len(packed), len(ids), zlib.crc32(ids))
    return b"".join([head, struct.pack(f"<{len(packed)}I", *map(len, packed)), *packed])


def decoded(data: bytes) -> np.ndarray:
    """The ids of encoded(); an error if the bytes aren't such a block, or not as they were written."""
    magic, kind, count, n, crc = HEADER.unpack_from(data)
    if magic != MAGIC or kind not in PLANES.values():
        raise ValueError("these bytes are no block of token ids")
    sizes = struct.unpack_from(f"<{count}I", data, HEADER.size)
    at, planes = HEADER.size + 4 * count, []
    for size in sizes:
        planes.append(np.frombuffer(_decompressor().decompress(data[at : at + size], max_output_size=n), np.uint8))
        at += size
    if kind == PLANES["byte"]:
        grid = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            grid[:, k] = plane
        ids = grid.view("<u4").ravel()
    else:
        ids = np.zeros(n, "<u4")
        for k, plane in enumerate(planes):
            ids |= np.unpackbits(plane, count=n, bitorder="little").astype("<u4") << np.uint32(k)
    if zlib.crc32(ids) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids


class Blocks:
    """Cuts a stream of documents' ids into blocks; gives (first id, [(document, its first id, its ids)] that begin in it, ids)."""

    def __init__(self, size: int):
        self.size, self.first, self.held, self.parts = size, 0, 0, []
        self.docs: deque = deque()

    def add(self, names: list, ids: np.ndarray, edges: np.ndarray):
        """names of documents, whose ids are ids[edges[i]:edges[i + 1]]."""
        begin = self.first + self.held
        self.docs.extend(zip(names, (begin + edges[:-1]).tolist(), np.diff(edges).tolist(), strict=True))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            whole = np.concatenate(self.parts)
            cut = len(whole) - len(whole) % self.size
            for at in range(0, cut, self.size):
                yield self._block(whole[at : at + self.size])
            self.parts, self.held = [whole[cut:].copy()], len(whole) - cut

    def end(self):
        whole = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        if len(whole):
            yield self._block(whole)

    def _block(self, ids: np.ndarray):
        first, some = self.first, []
        self.first += len(ids)
        while self.docs and self.docs[0][1] < self.first:
            some.append(self.docs.popleft())
        return first, some, ids


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, planes: str = "byte", block: int = BLOCK, level: int = LEVEL, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of docs in ascending order of ids to a new folder at path.

    Rows are dealt by range of (id, hash of the text) and sorted, so repeated ids don't meet in one task; each task encodes
    its rows run by run and writes the blocks of its shard. Null ids come first, rows of one id in the order of a hash of
    their texts, null texts are empty: the end id alone. Memory is that of a run of texts and of a block. Other columns
    aren't read. No rows: tables without rows.
    """
    if planes not in PLANES or block < 1:
        raise ValueError("planes are byte or bit, and a block has at least one id")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.withColumn("_mix", F.xxhash64("_text")).repartitionByRange("_id", "_mix").sortWithinPartitions("_id", "_mix").select("_id", "_text")
    names = ["shard", "chunk", "first", "n_ids", "ids_crc32", "n_bytes", "doc_ids", "doc_firsts", "doc_tokens", "payload"]

    def run(batches):
        encoder, shard, cut, number, id_type = tokens(tokenizer), TaskContext.get().partitionId(), Blocks(block), 0, None

        def rows_of(blocks):
            nonlocal number
            for first, some, ids in blocks:
                data = encoded(ids, planes, level)
                lists = [pa.array([[d[k] for d in some]], pa.list_(t)) for k, t in enumerate((id_type, pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (shard, number, first, len(ids), zlib.crc32(ids), len(data))], *lists, pa.array([data], pa.binary())], names)
                number += 1

        for batch in released(batches):
            id_type = batch.column(0).type
            for a, ids, edges in encoder.of(batch.column(1), RUN_BYTES):
                yield from rows_of(cut.add(batch.column(0).slice(a, len(edges) - 1).to_pylist(), ids, edges))
        yield from rows_of(cut.end())

    schema = "shard bigint, chunk bigint, first bigint, n_ids bigint, ids_crc32 bigint, n_bytes bigint, " + f"doc_ids array<{kind}>, doc_firsts array<bigint>, doc_tokens array<bigint>, payload binary"
    in_arrow(rows, run, schema).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(schema).parquet(f"{path}/chunks")
    # A row for each task that wrote.
    sizes = sorted((r["shard"], r["n"]) for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    spark.createDataFrame([(s, at, n) for (s, n), at in zip(sizes, starts, strict=False)], "shard bigint, start bigint, n_ids bigint").coalesce(1).write.parquet(f"{path}/shards")
    placed = chunks.join(F.broadcast(_shards(spark, path)), "shard")
    placed.select("shard", "chunk", (F.col("start") + F.col("first")).alias("start"), "n_ids", "n_bytes", "ids_crc32", F.size("doc_ids").alias("n_docs")).write.parquet(f"{path}/index")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """As many rows as tasks wrote."""
    return spark.read.schema("shard bigint, start bigint, n_ids bigint").parquet(f"{path}/shards").select("shard", "start")


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document of a folder of token files: id, start (ids of all before it), n_tokens, ids_crc32, with_ids: ids.

    A shard's chunks go through one task in order, decoded one at a time; only compressed bytes are shuffled. Damaged
    blocks are an error. An empty folder of files: no rows.
    """
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = chunks.join(F.broadcast(_shards(spark, path)), "shard").select("shard", "chunk", "start", "first", "doc_ids", "doc_firsts", "doc_tokens", "payload").repartition("shard").sortWithinPartitions("shard", "chunk")
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        # The document that goes on in the next chunk: (id, start, tokens), tokens still to come, crc so far, parts.
        open_doc = None
        for batch in released(batches):
            columns: list[list] = [[] for _ in names]
            id_type = batch.column(4).type.value_type
            for i in range(len(batch)):
                base, first = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                ids, at = decoded(batch.column(7)[i].as_py()), 0
                begun = zip(*[batch.column(c)[i].as_py() for c in (4, 5, 6)], strict=True)
                while True:
                    if open_doc is None:
                        if (new := next(begun, None)) is None:
                            break
                        name, place, n = new
                        open_doc, at = [(name, base + place, n), n, 0, []], place - first
                    part = ids[at : at + open_doc[1]]
                    open_doc[1:3] = open_doc[1] - len(part), zlib.crc32(part, open_doc[2])
                    if with_ids:
                        open_doc[3].append(part)
                    if open_doc[1]:
                        break
                    whole = (*open_doc[0], open_doc[2]) + ((np.concatenate(open_doc[3]),) if with_ids else ())
                    for c, x in zip(columns, whole, strict=True):
                        c.append(x)
                    open_doc = None
            if columns[0]:
                types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return rows.transform(in_arrow, run, schema).withColumnRenamed("id", id_col)


def ids_between(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the ids at places start to stop of the whole corpus, a row for each chunk that holds some; other chunks' bytes aren't read."""
    index = spark.read.parquet(f"{path}/index").where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "payload")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                at, ids = batch.column(0)[i].as_py(), decoded(batch.column(1)[i].as_py())
                low, high = max(start - at, 0), min(stop - at, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([at + low]), pa.array([ids[low:high]], pa.list_(pa.int64()))], ["start", "ids"])

    return chunks.join(index.select("shard", "chunk", "start"), ["shard", "chunk"]).select("start", "payload").transform(in_arrow, run, "start bigint, ids array<bigint>")


def token_file_query(docs: DataFrame) -> DataFrame:
    """Writes docs to token files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = common.scratch_path(spark, "token-files")
    write_token_files(docs, path)
    return read_token_files(spark, path)
