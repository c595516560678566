"""Phrase collocations of a corpus by pivot partitioning: a phrase is mined where its rarest word is.

Texts are rewritten to what can still make a frequent phrase: frequent words only. Around each word of a text the longest
run of words no rarer than it goes to that word's partition, its pivot's; there the phrases that hold the pivot are counted.
Of words as rare as each other in a phrase the leftmost owns it, so each occurrence of a phrase is counted once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm import common
from tidefold.llm.common import LOWER, Words, in_arrow, looked_up, mixed, released, stored, text_runs

#: Bytes that end a piece, and bytes of words: all but these, space and tab.
BREAK_BYTES = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
#: No word: ids are from 0 up.
NONE = -1
WORD_BYTES = ~BREAK_BYTES & np.array([b not in (9, 32) for b in range(256)])
#: Bytes of whole texts that a task takes apart at once.
RUN_BYTES = 2 << 20
#: Up to so many frequent words (21 bytes each) go to every task; beyond it words and their counts meet by a shuffle.
MOST_WORDS = 2_000_000
#: Fragments that a task mines at once.
MINED = 400_000
#: Parts into which the fragments of a frequent pivot, and the phrases of a language, are dealt.
PARTS = 64


def _language(name: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((name if name is not None else "und").encode(), digest_size=8).digest(), "little")


class Run:
    """Words of a run of texts: key (64 bits of hash of language and word), doc, joined (the next word follows in the same piece)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray):
        self.words = w = Words(LOWER[data], offsets, WORD_BYTES)
        self.doc = w.doc
        self.key = mixed(w.hashes() ^ languages[w.doc])
        seen = np.cumsum(BREAK_BYTES[data], dtype=np.int32)
        self.joined = np.zeros(len(w.starts), bool)
        if len(w.starts) > 1:
            self.joined[:-1] = (w.doc[1:] == w.doc[:-1]) & (seen[w.starts[1:] - 1] == seen[w.ends[:-1] - 1])

    def texts(self, some: np.ndarray) -> pa.Array:
        """The words at some places as strings."""
        starts, size = self.words.starts[some], (self.words.ends - self.words.starts)[some]
        edges = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], size)
        return pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.words.data[at]))).cast(pa.string())


def _runs(batches):
    """(language of each row, its hash, Run) of runs of whole texts; batches of (language, text)."""
    for batch in released(batches):
        names = batch.column(0).fill_null("und").to_pylist()
        known = {n: _language(n) for n in set(names)}
        codes = np.array([known[n] for n in names], np.uint64)
        for a, b, data, offsets in text_runs(batch.column(1), RUN_BYTES):
            yield names[a:b], codes[a:b], Run(data, offsets, codes[a:b])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(batches):
    for names, codes, run in _runs(batches):
        key, first, n = np.unique(run.key, return_index=True, return_counts=True)
        row = run.doc[first]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in row], pa.string()), _signed(codes[row]), _signed(key), run.texts(first), pa.array(n.astype(np.int64))], ["lang", "lang_key", "key", "word", "n"])


def neighbours(rank: np.ndarray, joined: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each word and d = 1..most: whether the d words left of it are all more frequent, and whether the d right of it are no rarer; in its piece, without a gap.

    rank: from 0, the most frequent, up; below 0 for words that aren't frequent.
    """
    n = len(rank)
    left, right = [], []
    here = rank >= 0
    sides = [here.copy(), here.copy()]
    for d in range(1, most + 1):
        ok_left, ok_right = np.zeros(n, bool), np.zeros(n, bool)
        if d < n:
            ok_right[: n - d] = sides[1][: n - d] & joined[d - 1 : n - 1] & (rank[d:] >= 0) & (rank[d:] <= rank[:-d])
            ok_left[d:] = sides[0][d:] & joined[: n - d] & (rank[:-d] >= 0) & (rank[:-d] < rank[d:])
        sides = [ok_left, ok_right]
        left.append(ok_left)
        right.append(ok_right)
    return left, right


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct row, which of them each row is)."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mixed(h ^ c.view(np.uint64)) + np.uint64(1)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if all((c == c[first[back]]).all() for c in columns):
        return first, back
    order = np.lexsort(columns)
    new = np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)))
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _sides(most: int) -> list[str]:
    return [f"l{d}" for d in range(1, most + 1)] + [f"r{d}" for d in range(1, most + 1)]


def _fragments(base: DataFrame, words: DataFrame, total: int, most: int, most_words: int) -> DataFrame:
    """(lang_key, pivot, salt, l1.., r1.., n): each word's fragment, NONE beyond its ends; those of a run of texts that are equal count once. salt spreads the fragments of pivots that are at least 1/HOT of all words."""
    hot = max(total / common.HOT, 2)
    names = ["lang_key", "pivot", "salt", *_sides(most), "n"]
    schema = ", ".join(f"{c} {'int' if c == 'salt' else 'bigint'}" for c in names)
    if words.limit(most_words + 1).count() <= most_words:
        table = words.select("key", "n", "id").toArrow()
        key, n, name = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("id").to_numpy()
        order = np.argsort(key)
        key, n, name = key[order], n[order], name[order]
        rank = np.empty(len(key), np.int32)
        rank[np.lexsort((name, -n))] = np.arange(len(key))
        sent = base.sparkSession.sparkContext.broadcast((key, rank, n >= hot, name))

        def run(batches):
            key, rank, often, name = sent.value
            for _, codes, r in _runs(batches):
                if not len(r.key) or not len(key):
                    continue
                at = np.minimum(np.searchsorted(key, r.key), len(key) - 1)
                own = np.where(key[at] == r.key, rank[at], -1)
                left, right = neighbours(own, r.joined, most)
                some = np.flatnonzero(left[0] | right[0])
                ids = name[at]
                columns = [ids[some]]
                for sign, flags in ((-1, left), (1, right)):
                    for d, flag in enumerate(flags, 1):
                        on = flag[some]
                        columns.append(np.where(on, ids[np.where(on, some + sign * d, 0)], NONE))
                first, back = _grouped(columns)
                times = np.bincount(back, minlength=len(first))
                wide = often[at[some[first]]]
                spread = np.zeros(len(first), np.int32)
                if wide.any():
                    mix = np.zeros(len(first), np.uint64)
                    for c in columns:
                        mix = mixed(mix ^ c[first].view(np.uint64))
                    spread = np.where(wide, 1 + (mix % np.uint64(PARTS)).astype(np.int32), 0).astype(np.int32)
                arrays = [pa.array(c[first]) for c in columns]
                yield pa.RecordBatch.from_arrays([_signed(codes[r.doc[some[first]]]), arrays[0], pa.array(spread), *arrays[1:], pa.array(times.astype(np.int64))], names)

        return base.transform(in_arrow, run, schema)

    def placed(batches):
        row = TaskContext.get().partitionId() << 33
        for _, codes, r in _runs(batches):
            piece = np.concatenate(([0], np.cumsum(~r.joined)[:-1])) if len(r.key) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row + r.doc), _signed(codes[r.doc]), pa.array(np.arange(len(r.key))), pa.array(piece.astype(np.int64)), _signed(r.key)], ["row", "lang_key", "pos", "piece", "key"])
            row += len(codes)

    places = stored(base.transform(in_arrow, placed, "row bigint, lang_key bigint, pos bigint, piece bigint, key bigint"), "places")
    known = looked_up(places, words.select("key", "id", F.col("n").alias("f")), "key", "f", total).where("f is not null")
    w = Window.partitionBy("row").orderBy("pos")
    one = F.struct("pos", "piece", "id", "f")
    near = {f"l{d}": F.lag(one, d).over(w) for d in range(1, most + 1)} | {f"r{d}": F.lead(one, d).over(w) for d in range(1, most + 1)}
    rows = known.select("lang_key", "pos", "piece", F.col("id").alias("pivot"), "f", *[v.alias(f"_{c}") for c, v in near.items()])
    out: dict[str, Column] = {}
    for side, sign in (("l", -1), ("r", 1)):
        before = F.lit(True)
        for d in range(1, most + 1):
            x = F.col(f"_{side}{d}")
            same = (x["id"] == F.col("pivot")) if side == "r" else F.lit(False)
            before = before & F.coalesce((x["pos"] == F.col("pos") + sign * d) & (x["piece"] == F.col("piece")) & ((x["f"] > F.col("f")) | ((x["f"] == F.col("f")) & ((x["id"] < F.col("pivot")) | same))), F.lit(False))
            out[f"{side}{d}"] = F.when(before, x["id"]).otherwise(NONE)
    rows = rows.select("lang_key", "pivot", "f", *[v.alias(c) for c, v in out.items()]).where((F.col("l1") != NONE) | (F.col("r1") != NONE))
    spread = F.when(F.col("f") >= hot, 1 + F.pmod(F.xxhash64("pivot", *out), F.lit(PARTS))).otherwise(0).cast("int")
    return rows.select("lang_key", "pivot", spread.alias("salt"), *out).groupBy(*names[:-1]).agg(F.count("*").alias("n"))


class Miner:
    """Counts the phrases that hold their pivot in fragments that come sorted by pivot, MINED at a time.

    Where all fragments of a pivot are at hand, only what comes least times grows longer, and only that is given out;
    those of a salted pivot, or of one that doesn't fit, are all given out, as parts of sums.
    """

    def __init__(self, least: int, longest: int):
        self.least, self.longest = least, longest
        self.held: list[np.ndarray] = []
        self.cut = None

    def add(self, rows: np.ndarray):
        """rows: columns lang_key, pivot, salt, l1.., r1.., n."""
        self.held.append(rows)
        if sum(x.shape[1] for x in self.held) >= MINED:
            rows = np.concatenate(self.held, 1)
            last = (rows[1:3] == rows[1:3, -1:]).all(0)
            if last.all():
                # A pivot that doesn't fit: what comes of it from here on are parts as well.
                self.cut, self.held = tuple(rows[1:3, -1]), []
                yield from self._mined(rows, np.zeros(rows.shape[1], bool))
            else:
                self.held = [rows[:, last]]
                yield from self._mined(rows[:, ~last], self._whole(rows[:, ~last]))

    def end(self):
        if self.held:
            rows = np.concatenate(self.held, 1)
            yield from self._mined(rows, self._whole(rows))

    def _whole(self, rows: np.ndarray) -> np.ndarray:
        whole = rows[2] == 0
        return whole if self.cut is None else whole & ~((rows[1] == self.cut[0]) & (rows[2] == self.cut[1]))

    def _mined(self, rows: np.ndarray, whole: np.ndarray):
        """(lang_key, words by column, count) of phrases of each shape."""
        most = self.longest - 1
        pivot, sides, n = rows[1], rows[3:-1], rows[-1]
        word = lambda k: pivot if k == 0 else sides[-k - 1] if k < 0 else sides[most + k - 1]
        alive = {(0, 0): np.ones(rows.shape[1], bool)}
        for size in range(1, self.longest):
            for left in range(size + 1):
                right = size - left
                ok = np.ones(rows.shape[1], bool)
                for shorter, far in (((left - 1, right), -left), ((left, right - 1), right)):
                    if min(shorter) >= 0:
                        ok &= alive[shorter] & (word(far) != NONE)
                some = np.flatnonzero(ok)
                alive[left, right] = ok
                if not len(some):
                    continue
                columns = [word(k)[some] for k in range(-left, right + 1)]
                first, back = _grouped(columns)
                total = np.bincount(back, n[some], len(first)).astype(np.int64)
                enough = (total >= self.least) | ~whole[some[first]]
                ok[some] = enough[back]
                first, total = first[enough], total[enough]
                if len(first):
                    yield rows[0][some[first]], [c[first] for c in columns], total


def _mining(least: int, longest: int):
    def run(batches):
        miner = Miner(least, longest)

        def out(made):
            for lang, words, total in made:
                flat = np.stack(words, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(lang), lists, pa.array(total)], ["lang_key", "phrase", "a"])

        for batch in released(batches):
            if len(batch):
                yield from out(miner.add(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])))
        yield from out(miner.end())

    return run


def phrase_counts(docs: DataFrame, *, least: int = 30, longest: int = 4, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, languages), stored.

    phrases: lang_key, phrase (array of word ids), a: all phrases of 2 to longest words that come least times or more.
    words: lang, lang_key, key, word, n and id (short numbers, which pack well) of words that come so often. languages: lang, n, the count of all words.
    """
    base = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    table = base.transform(in_arrow, _counted, "lang string, lang_key bigint, key bigint, word string, n bigint")
    table = stored(table.groupBy("lang", "lang_key", "key", "word").agg(F.sum("n").alias("n")), "word-counts")
    words = stored(table.where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()), "frequent-words")
    languages = stored(table.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    total = languages.agg(F.sum("n")).first()[0] or 0
    some = _fragments(base, words, total, longest - 1, most_words)
    # Each pivot's fragments meet in one task, a frequent pivot's in PARTS; sums over the first are final there.
    some = some.repartition("lang_key", "pivot", "salt").sortWithinPartitions("pivot", "salt")
    local = some.transform(in_arrow, _mining(least, longest), "lang_key bigint, phrase array<bigint>, a bigint")
    return stored(local.groupBy("lang_key", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases"), words, languages


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The top collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what stands between spaces, tabs and breaks (. , ; : ! ? and line ends), A-Z in lower case; a phrase lies in one
    piece between breaks. All phrases of 2 to longest words that come least times or more are candidates, those inside a
    longer candidate with at least share percent of their count are left out. score is floor(2000000 a / (l + r)) of the cut,
    into l and r, that makes it lowest; n counts the language's words. Sorted by score, a (falling) and phrase.

    Words are counted first; those that come least times, at most most_words, go to every task, beyond that by a shuffle.
    What follows moves word ids only: fragments to their pivots, then the phrases found. Pivots of at least 1/HOT of all
    words are dealt over PARTS tasks. Words are told by 64-bit hashes.

    A null language is und, a null text is empty. Rows that repeat count each. Ids and other columns aren't read. A language
    without candidates has no rows; no rows: no rows.
    """
    phrases, words, languages = phrase_counts(docs, least=least, longest=longest, lang_col=lang_col, text_col=text_col, most_words=most_words)
    # The largest count of a longer candidate around each.
    parts = F.expr("filter(flatten(transform(sequence(2, size(phrase) - 1), m -> transform(sequence(1, size(phrase) - m + 1), i -> slice(phrase, i, m)))), x -> size(x) < size(phrase))")
    inner = phrases.where(F.size("phrase") > 2).select("lang_key", F.explode(parts).alias("phrase"), F.lit(None).cast("bigint").alias("a"), F.col("a").alias("around"))
    both = phrases.withColumn("around", F.lit(None).cast("bigint")).unionByName(inner).groupBy("lang_key", "phrase").agg(F.max("a").alias("a"), F.max("around").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = both.where(F.col("around").isNull() | (wide("around") * 100 < wide("a") * share))
    cuts = kept.select("lang_key", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(phrase, 1, k)"), "rest": F.expr("slice(phrase, k + 1, size(phrase) - k)")})
    counts = phrases.select("lang_key", "phrase", "a").unionByName(words.select("lang_key", F.array("id").alias("phrase"), F.col("n").alias("a")))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang_key", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang_key", part])
    score = F.expr("cast(2000000 * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS bigint)")
    best = cuts.groupBy("lang_key", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c")).select("lang_key", "phrase", "a", "_c.score", "_c.l", "_c.r")
    # Each part of a language keeps its own first ones, with all that tie with the last; words are put in only then.
    part = Window.partitionBy("lang_key", F.pmod(F.hash("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"))
    first = stored(best.withColumn("_rank", F.rank().over(part)).where(F.col("_rank") <= top).drop("_rank"), "first-phrases")
    spelt = first.select("lang_key", "phrase", F.posexplode("phrase").alias("_at", "id")).join(words.select("lang_key", "id", "lang", "word"), ["lang_key", "id"])
    spelt = spelt.groupBy("lang_key", "phrase").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("text"))
    rows = first.join(spelt, ["lang_key", "phrase"]).join(languages, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    return rows.select("lang", rank.cast("bigint").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score").where(F.col("rank") <= top)
