"""Language identification: script ranges narrow the candidates of a word, and Viterbi over word scores with a switching penalty labels spans."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import ALNUM_BYTES, LOWER, Words, fold, in_arrow, released, stored, text_runs

BITS = 16
#: First code points of scripts: 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian to Hebrew, 5 Arabic, 6 Indic, 7 Southeast Asian, 8 kana, 9 Han, 10 Hangul, 11 other. Which code points are letters Unicode's categories say.
_RANGES = ((0x00, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x600, 5), (0x900, 6), (0xE00, 7), (0x10A0, 11), (0x1E00, 1), (0x1F00, 2), (0x2000, 1), (0x2C00, 11), (0x3000, 8), (0x3100, 11), (0x3400, 9), (0xA000, 11), (0xAC00, 10), (0xD7B0, 11), (0xF900, 9), (0xFB00, 1), (0xFB13, 4), (0xFB50, 5), (0xFE00, 5), (0xFF00, 1), (0xFF66, 8), (0xFFA0, 10), (0x10000, 11), (0x20000, 9))
N_SCRIPTS = 12


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    """The script of each code point; 0 of what is no letter (categories L*)."""
    edges, numbers = zip(*_RANGES, strict=True)
    out = np.repeat(np.array(numbers, np.int8), np.diff((*edges, 0x110000)))
    return out * np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.int8, 0x110000)


def scripts(data: np.ndarray) -> np.ndarray:
    """The script of the letter that begins at each byte; 0 where none begins."""
    table = _scripts()
    out = np.zeros(len(data), np.int8)
    ascii_letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    out[ascii_letters] = 1
    for low, high, more, mask in ((0xC2, 0xDF, 1, 31), (0xE0, 0xEF, 2, 15), (0xF0, 0xF4, 3, 7)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + more < len(data)]
        code = data[at].astype(np.int64) & mask
        for j in range(1, more + 1):
            code = code << 6 | (data[at + j] & 63)
        out[at] = table[np.minimum(code, 0x10FFFF)]
    return out


def grams(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bin) of the byte trigrams and pentagrams around every byte of a word, words being bordered by blanks."""
    inside = np.zeros(len(data) + 1, np.int32)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    inside = np.cumsum(inside[:-1]) > 0
    padded = np.full(len(data) + 4, 32, np.uint64)
    padded[2:-2] = np.where(inside, data, 32)
    at = np.flatnonzero(inside)
    word = np.repeat(np.arange(len(w.starts)), w.ends - w.starts)
    # A border that another text follows directly counts as a blank too.
    first, last = at == w.starts[word], at == w.ends[word] - 1
    left, here, right = np.where(first, 32, padded[at + 1]), padded[at + 2], np.where(last, 32, padded[at + 3])
    three = (left << np.uint64(16) | here << np.uint64(8) | right).astype(np.uint64)
    wide = ~first & ~last
    far = (padded[at] << np.uint64(32) | three << np.uint64(8) | padded[at + 4])[wide]
    shift = np.uint64(64 - BITS)
    a = (three * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) >> shift
    b = (far * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93) >> shift
    return np.concatenate((word, word[wide])), np.concatenate((a, b)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: log probability of each bin by language, and whether a script's words can be of a language.
    table: np.ndarray
    allowed: np.ndarray


#: What a language that a word's scripts rule out scores: below any sum over a text that isn't ruled out, and still finite.
RULED_OUT = -1e9


def word_scores(model: Model, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each word by language, whether it has a letter). A word without a letter says nothing.

    The script of most of a word's letters, the first of equals, leaves only the languages that use it.
    """
    word, at = grams(data, w)
    n, k = len(w.starts), len(model.languages)
    if not n:
        return np.zeros((0, k)), np.zeros(0, bool)
    out = np.stack([np.bincount(word, model.table[at, j], n) for j in range(k)], 1)
    # Overlapping grams count for less than independent ones.
    out *= 0.4
    script = scripts(data)
    letters = np.flatnonzero(script)
    place = np.searchsorted(w.starts, letters, "right") - 1
    inside = (place >= 0) & (letters < w.ends[np.maximum(place, 0)])
    count = np.bincount(place[inside] * N_SCRIPTS + script[letters[inside]], minlength=n * N_SCRIPTS).reshape(n, N_SCRIPTS)
    has = count.any(1)
    out[~has] = 0
    out -= out.max(1, keepdims=True)
    out[has] = np.where(model.allowed[count[has].argmax(1)], out[has], RULED_OUT)
    return out, has


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; a change of label within a text costs penalty. All texts advance together, word by word, longest first."""
    n, k = scores.shape
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    value = np.zeros((len(order), k))
    origin, best = np.zeros((n, k), bool), np.zeros(n, np.int32)
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for t, m in enumerate(active.tolist()):
        at = begin[:m] + t
        v = value[:m]
        if t:
            top = v.argmax(1)
            jump = v[np.arange(m), top] - penalty
            stay = v >= jump[:, None]
            v = np.maximum(v, jump[:, None])
            origin[at], best[at] = stay, top
        value[:m] = v + scores[at]
    label = np.zeros(n, np.int32)
    now = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at, own = begin[:m] + t, now[:m]
        label[at] = own
        if t:
            now[:m] = np.where(origin[at, own], own, best[at])
    return label


def fit(docs: DataFrame, train: Column, *, id_col: str, text_col: str, lang_col: str, most_rows: int, most_languages: int) -> Model:
    """Gram frequencies by language of at most most_rows rows under train with text and language, taken by the hash of the id; of their languages the most_languages with most text are learned."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.where("_text is not null and _lang is not null").where(train)
    order = F.pmod(F.xxhash64(F.lit("language"), "_id"), F.lit(1_000_000))
    n = rows.select("_id").count()
    ids = rows.select("_id", order.alias("_o")).where(F.col("_o") < int(1_200_000 * min(1.0, most_rows / max(n, 1))) + 1).orderBy("_o", "_id").limit(most_rows).select(F.col("_id").alias("_sid")).distinct()
    sample = rows.join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_sid"))).select("_lang", "_text")

    def counted(batches):
        for batch in released(batches):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            for a, b, raw, offsets in text_runs(batch.column(1)):
                data = LOWER[raw]
                w = Words(data, offsets, ALNUM_BYTES)
                word, at = grams(data, w)
                script = scripts(data)
                letters = np.flatnonzero(script)
                row = np.searchsorted(offsets, letters, "right") - 1
                # Bins of grams, and below 0 those of scripts: only those that occur are held.
                both = np.concatenate((number[a + w.doc[word]] << 32 | at + N_SCRIPTS, number[a + row] << 32 | script[letters]))
                both, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(both >> 32)), pa.array((both & 0xFFFFFFFF) - N_SCRIPTS), pa.array(n)], ["lang", "bin", "n"])

    counts = stored(sample.transform(in_arrow, counted, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "grams")
    learned = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in learned.collect())
    # At most 2**16 bins and the scripts for each of most_languages.
    got = counts.where(F.col("lang").isin(languages)).toPandas()
    k = len(languages)
    table, seen = np.full((1 << BITS, k), 0.5, np.float32), np.zeros((N_SCRIPTS, k))
    number = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    at, n = got["bin"].to_numpy(np.int64), got["n"].to_numpy(float)
    table[at[at >= 0], number[at >= 0]] += n[at >= 0]
    seen[at[at < 0] + N_SCRIPTS, number[at < 0]] += n[at < 0]
    allowed = seen >= 0.001 * np.maximum(seen.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(languages, np.log(table / table.sum(0, dtype=np.float64)).astype(np.float32), allowed)


def language_spans(docs: DataFrame, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 8.0, most_rows: int = 20_000, most_languages: int = 256) -> DataFrame:
    """One row for each row of docs: id, lang_pred, score, spans.

    Fitted on at most most_rows rows under train (a condition on _id; all by default) and the most_languages languages
    with most text among them. The script of most of a word's letters leaves only the languages that use it; its score
    by language is the naive Bayes sum over its byte grams. Viterbi labels the words, a change of language costing
    penalty, and spans lists the runs: language, first byte and end byte in UTF-8. lang_pred is the language of most
    letters (bytes of words with a letter), on ties the first by name, score its share of them.

    A null text or one without a letter (Unicode categories L*: digits, marks and emoji are none) is und, score 0,
    without spans. Without a training row all is und. Null languages are not learned. Repeated rows come out each; extra
    columns are not read. No rows: no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, F.lit(True) if train is None else train, id_col=id_col, text_col=text_col, lang_col=lang_col, most_rows=most_rows, most_languages=most_languages))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        m = model.value
        k = len(m.languages)
        for batch in released(batches):
            # Scores of words by language are the largest arrays.
            for a, b, raw, offsets in text_runs(batch.column(1), min(1 << 20, (8 << 20) // max(k, 1))):
                rows = b - a
                if not k:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(["und"] * rows), pa.array([0.0] * rows), pa.array([[]] * rows, pa.list_(span))], ["_id", "lang_pred", "score", "spans"])
                    continue
                data = LOWER[raw]
                w = Words(data, offsets, ALNUM_BYTES)
                scores, has = word_scores(m, data, w)
                label = viterbi(scores, w.first, penalty)
                letters = np.bincount((w.doc * k + label)[has], (w.ends - w.starts)[has], rows * k).reshape(rows, k)
                total = letters.sum(1)
                best = letters.argmax(1)
                names = [m.languages[j] if t else "und" for j, t in zip(best, total, strict=True)]
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
                new[w.first[:-1][np.diff(w.first) > 0]] = True
                begin = np.flatnonzero(new)
                end = np.concatenate((begin[1:], [len(label)])) - 1 if len(begin) else begin
                base = offsets[w.doc[begin]]
                flat = pa.StructArray.from_arrays([pa.array(m.languages).take(pa.array(label[begin].astype(np.int32))), pa.array((w.starts[begin] - base).astype(np.int32)), pa.array((w.ends[end] - base).astype(np.int32))], fields=list(span))
                edges = np.searchsorted(begin, w.first)
                # Without a letter there are no spans.
                if not total.all():
                    some = np.repeat(total > 0, np.diff(edges))
                    flat, edges = flat.filter(pa.array(some)), np.concatenate(([0], np.cumsum(np.where(total > 0, np.diff(edges), 0))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(names), pa.array(np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)], ["_id", "lang_pred", "score", "spans"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).transform(in_arrow, run, f"_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")
    return out.withColumnRenamed("_id", id_col)


def language_query(docs: DataFrame) -> DataFrame:
    """id, held_out, lang_pred, score and the number of spans; learned outside the fold (crc32 of the id modulo 5 is 0).

    A null id is in the fold of the empty text; all else as in language_spans.
    """
    found = language_spans(docs, train=fold(F.col("_id"), 5) != 0)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
