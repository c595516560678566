"""Packing of documents into training sequences over several context sizes, with gaps of long windows filled from shorter tiers."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import LOWER, NON_BLANK_BYTES, Words, in_arrow, released, text_runs

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
#: Tokens of a step group, and how many groups of a window are balanced against each other.
STEP_TOKENS = 65_536
DEALT = 8
#: Tokens that a task holds back, so that there are pieces of all lengths for the gaps.
RESERVE = 1 << 18
#: Bytes of whole texts that are encoded at once.
RUN_BYTES = 2 << 20

_KIND = np.ones(256, np.uint8)  # 0 blank, 1 other, 2 ASCII letter, 3 full stop or comma
_KIND[~NON_BLANK_BYTES] = 0
_KIND[97:123] = 2
_KIND[[44, 46]] = 3


class Tokens:
    """Token ids of texts: each distinct unit of a run of texts is encoded once, and frequent units once for a process.

    Units are cut at blanks, and between an ASCII letter and a full stop or comma, where the tokenizer always cuts.
    Texts that hold a special token's name are encoded whole.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Ids of the first units seen, as bytes; the bound is on their number.
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, words: list[str]) -> list[bytes]:
        """Ids of each unit, as bytes. Units of letters only are one piece of the tokenizer's own splitting, so many are encoded as one text and told apart by their last tokens."""
        out: list[bytes] = [self.known.get(w) for w in words]  # type: ignore[misc]
        new = [i for i, x in enumerate(out) if x is None]
        plain = [i for i in new if words[i].isalpha()]
        rest = [i for i in new if not words[i].isalpha()]
        for a in range(0, len(plain), 8000):
            groups = [plain[k : k + 1000] for k in range(a, min(a + 8000, len(plain)), 1000)]
            for group, ids in zip(groups, self._whole([" ".join([words[i] for i in g]) for g in groups]), strict=True):
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group):
                    raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                    for n, i in enumerate(group):
                        out[i] = raw[at[n] : at[n + 1]]
                else:
                    rest += group
        for a in range(0, len(rest), 4096):
            for i, ids in zip(rest[a : a + 4096], self._whole([words[i] for i in rest[a : a + 4096]]), strict=True):
                out[i] = ids.tobytes()
        room = self.remembered - len(self.known)
        if room > 0:
            self.known.update((words[i], out[i]) for i in new[:room] if len(words[i]) <= 32)
        return out

    def of(self, texts: pa.Array, run_bytes: int = RUN_BYTES):
        """Yields (first row, ids, first id of each row and one more) of runs of texts; each text ends with END_ID."""
        for a, b, raw, offsets in text_runs(texts, run_bytes):
            data = LOWER[raw]
            w = Words(data, offsets, NON_BLANK_BYTES)
            kind = _KIND[data]
            pair = kind[:-1] * 4 + kind[1:] if len(kind) else kind
            border = np.zeros(len(data) + 1, bool)
            border[offsets] = True
            cuts = np.flatnonzero((pair == 11) | (pair == 14)) + 1
            cuts = cuts[~border[cuts]]
            starts, ends = np.sort(np.concatenate((w.starts, cuts))), np.sort(np.concatenate((w.ends, cuts)))
            size = np.concatenate(([0], np.cumsum(ends - starts)))
            letters = np.ascontiguousarray(data[kind > 0])
            coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
            known = self.units(coded.dictionary.to_pylist())
            length = np.array([len(x) for x in known], np.int64) // 4
            begin = np.concatenate(([0], np.cumsum(length)))
            flat = np.frombuffer(b"".join(known), np.uint32)
            own = coded.indices.to_numpy()
            n = length[own]
            before = np.concatenate(([0], np.cumsum(n)))
            at = np.arange(before[-1])
            at += np.repeat(begin[own] - before[:-1], n)
            ids = flat[at]
            edges = before[np.searchsorted(starts, offsets)]
            if b"<|" in (whole := raw.tobytes()):
                rows = [ids[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                for k in range(b - a):
                    part = whole[offsets[k] : offsets[k + 1]]
                    if b"<|" in part:
                        rows[k] = self._whole([part.decode()])[0]
                edges = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
                ids = np.concatenate(rows)
            # One END_ID after each text.
            out = np.empty(len(ids) + b - a, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(edges))] = ids
            out[edges[1:] + np.arange(b - a)] = END_ID
            yield a, out, edges + np.arange(b - a + 1)


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    """One for a process, however many tasks it runs."""
    return Tokens(path)


class Packer:
    """Packs the documents of a task, fed run by run, into sequences that fill their windows, powers of two.

    Whole windows of the largest size are cut from long documents first. The rest of each goes to the smallest tier that
    holds it. From the largest tier down, the longest piece opens a window, the gap takes the longest piece of any
    shorter size that fits, again and again, and what is then left takes the front of the shortest longer piece. Until
    the end at least reserve tokens stay in stock; when they run out, the last window is laid out as sequences of smaller
    powers of two.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, reserve: int = RESERVE):
        self.tiers, self.reserve, self.left = tiers, max(reserve, tiers[0]), 0
        self.stock: dict[int, list[tuple]] = {}
        self.sizes: list[int] = []

    def _put(self, n: int, doc, start: int) -> None:
        if n not in self.stock:
            self.stock[n] = []
            insort(self.sizes, n)
        self.stock[n].append((doc, start))
        self.left += n

    def _take(self, place: int) -> tuple:
        n = self.sizes[place]
        doc, start = self.stock[n].pop()
        if not self.stock[n]:
            del self.stock[n], self.sizes[place]
        self.left -= n
        return doc, start, n

    def add(self, docs) -> list[tuple[int, list[tuple]]]:
        """Takes (document, tokens) in; returns sequences: (window, [(document, start, length)])."""
        largest, out = self.tiers[0], []
        for doc, n in docs:
            out += [(largest, [(doc, start, largest)]) for start in range(0, n - largest + 1, largest)]
            if n % largest:
                self._put(n % largest, doc, n - n % largest)
        return out + self._filled(self.reserve)

    def end(self) -> list[tuple[int, list[tuple]]]:
        """Sequences of all that is in stock."""
        return self._filled(0)

    def _filled(self, reserve: int) -> list[tuple[int, list[tuple]]]:
        out = []
        for k, window in enumerate(self.tiers):
            least = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while self.sizes and self.sizes[-1] > least and self.left >= reserve:
                pieces = [self._take(len(self.sizes) - 1)]
                gap = window - pieces[0][2]
                while gap and self.sizes:
                    place = bisect_right(self.sizes, gap) - 1
                    if place < 0:
                        doc, start, n = self._take(0)
                        self._put(n - gap, doc, start + gap)
                        pieces.append((doc, start, gap))
                        gap = 0
                    else:
                        pieces.append(self._take(place))
                        gap -= pieces[-1][2]
                out += [(window, pieces)] if not gap else _laid_out(pieces, window - gap)
        return out

    def held(self):
        """What is in stock, to be changed in place: lists of (document, start) by length."""
        return self.stock.items()


def _laid_out(pieces: list[tuple], total: int) -> list[tuple[int, list[tuple]]]:
    """Sequences of powers of two that hold the pieces, total tokens, one after the other."""
    out: list[tuple[int, list[tuple]]] = []
    room = 0
    for doc, start, n in pieces:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                total -= room
                out.append((room, []))
            cut = min(n, room)
            out[-1][1].append((doc, start, cut))
            start, n, room = start + cut, n - cut, room - cut
    return out


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int]]:
    """(row, start, length, sequence, offset, window) of pieces that cover all rows, by one Packer."""
    packer = Packer(tiers)
    out = []
    for number, (window, pieces) in enumerate(packer.add(enumerate(lengths.tolist())) + packer.end()):
        at = 0
        for row, start, n in pieces:
            out.append((row, start, n, number, at, window))
            at += n
    return out


def cost(pieces: list[tuple]) -> int:
    """Pairs of tokens that attend to each other: what a sequence costs besides its tokens."""
    return sum(n * n for _, _, n in pieces)


class Steps:
    """Deals sequences of one window into step groups of step_tokens tokens, several groups at a time, so that their costs are alike."""

    def __init__(self, step_tokens: int, first: int):
        self.step_tokens, self.next = step_tokens, first
        self.waiting: dict[int, list[list[tuple]]] = {}

    def add(self, sequences) -> list[tuple[int, int, list[tuple]]]:
        """Takes (window, pieces) in; returns (group, window, pieces) of groups that are full."""
        out = []
        for window, pieces in sequences:
            some = self.waiting.setdefault(window, [])
            some.append(pieces)
            if len(some) == DEALT * self._size(window):
                out += self._dealt(window, DEALT)
        return out

    def end(self) -> list[tuple[int, int, list[tuple]]]:
        """What waits, in as few groups of each window as hold it, all within one sequence of each other."""
        return [x for w in sorted(self.waiting) for x in (self._dealt(w, -(-len(self.waiting[w]) // self._size(w))) if self.waiting[w] else [])]

    def _size(self, window: int) -> int:
        return max(1, self.step_tokens // window)

    def _dealt(self, window: int, groups: int) -> list[tuple[int, int, list[tuple]]]:
        # From the costliest on, to and fro.
        order = sorted(self.waiting[window], key=cost, reverse=True)
        out = []
        for i, pieces in enumerate(order):
            turn, place = divmod(i, groups)
            out.append((self.next + (place if turn % 2 == 0 else groups - 1 - place), window, pieces))
        self.next += groups
        self.waiting[window] = []
        return out


def packed(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group, with_ids: ids.

    The rows that a task reads are packed by one Packer, run by run of about RUN_BYTES of text whatever Arrow's batches
    are, so nothing is shuffled and memory is that of a run and a reserve; sequences fill their windows (powers of two)
    exactly, so none needs padding. step_group joins sequences of one window to step_tokens tokens, dealt by their
    attention cost; only what is left of each window at the end of a task makes smaller groups, of even size.

    Null and empty texts are the end id alone. Repeated rows are packed each. A null id stays null. Other columns are not
    read. No rows: no rows. tokenizer: path of the tokenizer's file; by default the public one named word_bpe_49k.json.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"] + ["ids"] * with_ids

    def run(batches):
        encoder, id_type = tokens(tokenizer), None
        task = TaskContext.get().partitionId() << 40
        packer, steps, number = Packer(), Steps(step_tokens, task), task

        def finished(sequences, steps_done):
            """A batch of rows of the sequences in groups that are full. A document is (id, ids, tokens, place of ids[0])."""
            nonlocal number
            dealt = steps.add(sequences) + (steps.end() if steps_done else [])
            columns: list[list] = [[] for _ in names]
            for group, window, pieces in dealt:
                at = 0
                for (name, ids, total, base), start, n in pieces:
                    part = ids[start - base : start - base + n]
                    for c, x in zip(columns, (name, start, n, zlib.crc32(part), total, number, at, window, group, part), strict=False):
                        c.append(x)
                    at += n
                number += 1
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

        def own(doc, start: int, n: int):
            """The document with its own copy of the ids of this piece, so that the run's can go."""
            name, ids, total, base = doc
            return doc if ids.base is None else (name, ids[start - base : start - base + n].copy(), total, start)

        def own_copies():
            for n, some in packer.held():
                some[:] = [(own(doc, start, n), start) for doc, start in some]
            for some in steps.waiting.values():
                some[:] = [[(own(doc, start, n), start, n) for doc, start, n in pieces] for pieces in some]

        for batch in released(batches):
            id_type = batch.column(0).type
            for a, ids, edges in encoder.of(batch.column(1)):
                lengths = np.diff(edges).tolist()
                named = batch.column(0).slice(a, len(lengths)).to_pylist()
                rows = [((name, ids[e : e + n], n, 0), n) for name, e, n in zip(named, edges.tolist(), lengths, strict=False)]
                yield from finished(packer.add(rows), False)
                own_copies()
        yield from finished(packer.end(), True)

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window int, step_group bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).transform(in_arrow, run, schema).withColumnRenamed("id", id_col)
