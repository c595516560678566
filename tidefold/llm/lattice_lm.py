"""Language-model scores: the probability of a text summed over all its segmentations into an existing vocabulary's pieces."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import fold, in_arrow, stored

SPACE = "▁"
#: Words of at least 1/HEAD of all tokens, of which there are at most HEAD, are sent to all tasks.
HEAD = 1 << 17
#: Weight, in pieces, of the prior that the vocabulary's own order gives.
PRIOR = 32_000.0
#: Bytes of whole texts that a task takes apart at once; what it holds is a small multiple of this or of its longest text.
RUN_BYTES = 4 << 20


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """(processor, pieces as bytes or None, prior): bytes that a piece stands for; None for control pieces and such as a text in lower case can't hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces: list[bytes | None] = []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or any("A" <= c <= "Z" for c in piece):
            pieces.append(None)
        else:
            pieces.append(piece.encode())
    # The vocabulary's scores fall with rank; a piece's prior falls as the inverse of its rank.
    rank = np.argsort(np.argsort([-sp.get_score(i) for i in range(n)], kind="stable"))
    prior = np.where([p is not None for p in pieces], 1.0 / (rank + 100.0), 0.0)
    return sp, pieces, prior / prior.sum()


@lru_cache(maxsize=2)
def trie(path: str):
    """(class of each byte, next node by node and class, pieces that end at each node: up to two, -1 for none). Node 0 is dead, 1 the root."""
    _, pieces, _ = vocabulary(path)
    used = sorted({b for p in pieces if p for b in p})
    kind = np.zeros(256, np.int64)
    kind[used] = np.arange(1, len(used) + 1)
    step: list[dict[int, int]] = [{}, {}]
    ends: list[list[int]] = [[], []]
    for i, p in enumerate(pieces):
        if not p:
            continue
        at = 1
        for b in p:
            at = step[at].setdefault(int(kind[b]), len(step))
            if at == len(step):
                step.append({})
                ends.append([])
        ends[at].append(i)
    table = np.zeros((len(step), len(used) + 1), np.int32)
    for at, out in enumerate(step):
        for c, to in out.items():
            table[at, c] = to
    last = np.full((len(step), 2), -1, np.int32)
    for at, e in enumerate(ends):
        last[at, : min(2, len(e))] = e[:2]
    return kind, table, last


def lattice_scores(words: list[bytes], logp: np.ndarray, path: str) -> np.ndarray:
    """Natural log of the probability of each word, a space before it, summed over all segmentations: forward recursion in log space.

    Words of like length advance together. Single bytes are pieces of the vocabulary, so every word has a segmentation.
    """
    kind, table, last = trie(path)
    # A node's score: of one piece, or of a byte and a piece of the same bytes together.
    one = np.where(last[:, 0] >= 0, logp[last[:, 0]], -np.inf)
    score = np.where(last[:, 1] >= 0, np.logaddexp(one, logp[last[:, 1]]), one)
    space = SPACE.encode()
    out = np.empty(len(words))
    size = np.array([len(w) + len(space) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 16_384 and size[order[end]] <= size[order[at]] + 1:
            end += 1
        some = order[at:end]
        width = int(size[some[-1]])
        grid = np.frombuffer(b"".join((space + words[i]).ljust(width, b"\0") for i in some), np.uint8).reshape(len(some), width)
        codes = kind[grid]
        # Bytes beyond a word's end lead nowhere.
        codes[np.arange(width) >= size[some][:, None]] = 0
        alpha = np.full((width + 1, len(some)), -np.inf)
        alpha[0] = 0.0
        for start in range(width):
            alive = np.flatnonzero(alpha[start] > -np.inf)
            node = np.ones(len(alive), np.int32)
            for stop in range(start + 1, width + 1):
                node = table[node, codes[alive, stop - 1]]
                go = node > 0
                if not go.all():
                    alive, node = alive[go], node[go]
                if not len(alive):
                    break
                s = score[node]
                hit = s > -np.inf
                if hit.any():
                    rows = alive[hit]
                    alpha[stop, rows] = np.logaddexp(alpha[stop, rows], alpha[start, rows] + s[hit])
        out[some] = alpha[size[some], np.arange(len(some))]
        at = end
    return out


def _runs(batch: pa.RecordBatch):
    """Copies of runs of whole rows with about RUN_BYTES of text, which is column 1; the string kernels misread slices."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + RUN_BYTES, "right")))
        yield batch.take(pa.array(np.arange(at, end)))
        at = end


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, A-Z in lower case, as large strings; row of each)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    some = pc.not_equal(flat, "")
    return flat.filter(some), row[some.to_numpy(zero_copy_only=False)]


def lattice_lm(docs: DataFrame, *, train: Column | None = None, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (split at blanks, A-Z in lower case) and one end of each text. base_score sums log10 of the smoothed
    unigram frequency of the training rows (those under train, a condition on _id; all by default). score is the log10
    probability of the text under a unigram model over the pieces of an existing vocabulary, summed over all
    segmentations: a piece's score is its share in the training words' usual segmentation, with a prior that falls with
    the piece's rank in the vocabulary; the end is one more symbol, as frequent as training texts are.

    Words are counted over the whole corpus by pre-aggregated shuffles, and each distinct word is scored once. Words with
    at least 1/HEAD of all tokens (so at most HEAD) are broadcast; all others are joined, and none of them is frequent.

    A null text is empty: one token, the end. Without training rows every count is 0. Repeated rows are scored each; null
    ids are trained on as an empty id and stay null. Extra columns are not read. No rows: no rows.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    base = base.withColumn("_train", F.coalesce(train, F.lit(False)) if train is not None else F.lit(True))

    def counted(batches):
        for batch in (run for whole in batches for run in _runs(whole)):
            words, row = _words(batch.column(1))
            coded = words.dictionary_encode()
            codes, n = coded.indices.to_numpy(), len(coded.dictionary)
            learned = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            own = np.bincount(codes, learned[row], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(own), pa.array(np.bincount(codes, minlength=n).astype(np.int64))], ["word", "c", "n"])

    table = stored(base.transform(in_arrow, counted, "word string, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = base.where("_train").count()
    total = table.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    tokens, distinct = (total["c"] or 0) + ends, (total["v"] or 0) + (ends > 0)

    def pieces(batches):
        sp, known, _ = vocabulary(model_path)
        sums = np.zeros(len(known), np.int64)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a in range(0, len(words), 8192):
                ids = sp.encode(words[a : a + 8192], num_threads=1)
                at = np.array([i for x in ids for i in x], np.int64)
                sums += np.bincount(at, np.repeat(counts[a : a + 8192], [len(x) for x in ids]), len(known)).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["piece", "n"])

    # At most one row for each piece of the vocabulary.
    got = table.where("c > 0").select("word", "c").transform(in_arrow, pieces, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    _, known, prior = vocabulary(model_path)
    count = np.zeros(len(known))
    for r in got:
        count[r["piece"]] = r["n"]
    count[[p is None for p in known]] = 0
    share = count + PRIOR * prior
    whole = share.sum() + ends + 1
    with np.errstate(divide="ignore"):
        logp = np.log(share / whole)
    end_score = float(np.log10((ends + 1) / whole))

    def marginal(batches):
        for batch in batches:
            for a in range(0, len(batch), 65_536):
                part = batch.slice(a, 65_536)
                words = part.column(0).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lattice_scores(words, logp, model_path) / np.log(10))], ["word", "c", "n", "logp"])

    scored = stored(table.repartition("word").transform(in_arrow, marginal, "word string, c bigint, n bigint, logp double"), "scored-words") if total["n"] else table.withColumn("logp", F.lit(0.0))
    unit = tokens + 0.5 * (distinct + 1)
    head = scored.where(F.col("n") * HEAD >= (total["n"] or 0)).select("word", "c", "logp").toArrow()
    frequent = spark.sparkContext.broadcast((head.column("word").to_pylist(), head.column("c").to_numpy(), head.column("logp").to_numpy()))

    def split(batches):
        names, c, p = frequent.value
        names = pa.array(names, pa.large_string())
        worth = np.log10((c + 0.5) / unit)
        row_id = TaskContext.get().partitionId() << 33
        for batch in (run for whole in batches for run in _runs(whole)):
            m = len(batch)
            words, row = _words(batch.column(1))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy()
            at = place[codes] if len(codes) else np.empty(0, np.int64)
            hit = at >= 0
            r, k = row[hit], at[hit]
            # What isn't frequent: each row's distinct words and how often they come.
            both, often = np.unique(row[~hit] << 32 | codes[~hit].astype(np.int64), return_counts=True)
            edges = np.searchsorted(both >> 32, np.arange(m + 1))
            rare = coded.dictionary.take(pa.array(both & 0xFFFFFFFF)).cast(pa.string())
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x) for x in (rare, pa.array(often.astype(np.int32)))]
            columns = [pa.array(row_id + np.arange(m)), batch.column(0), pa.array(np.bincount(row, minlength=m).astype(np.int64)), pa.array(np.bincount(r, c[k] > 0, m).astype(np.int64)), pa.array(np.bincount(r, worth[k], m).astype(float)), pa.array(np.bincount(r, p[k], m).astype(float)), *lists]
            row_id += m
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n", "known", "base", "logp", "words", "often"])

    rows = stored(base.select("_id", "_text").transform(in_arrow, split, f"row bigint, id {kind}, n bigint, known bigint, base double, logp double, words array<string>, often array<int>"), "rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "often")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.often").alias("often"))
    # A frequent word is in no row's rest, so it needn't be joined.
    rest = scored.where(F.col("n") * HEAD < (total["n"] or 0)).select(F.col("word").alias("_w"), "c", F.col("logp").alias("_p"))
    joined = rare.join(rest, F.col("word") == F.col("_w"))
    more = joined.groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("_known"), F.sum(F.log10((F.col("c") + 0.5) / unit) * F.col("often")).alias("_base"), F.sum(F.col("_p") * F.col("often")).alias("_logp"))
    out = rows.drop("words", "often").join(more, rows["row"] == more["_row"], "left")
    end_base = float(np.log10((ends + 0.5) / unit))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("logp") + F.coalesce("_logp", F.lit(0.0)) + end_score).alias("score"),
    )


def lattice_query(docs: DataFrame) -> DataFrame:
    """lattice_lm of all rows, learned outside the fold (crc32 of the id modulo 5 is 1), with held_out.

    A null id is in the fold of the empty text; all else as in lattice_lm.
    """
    found = lattice_lm(docs, train=fold(F.col("_id"), 5) != 1)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
