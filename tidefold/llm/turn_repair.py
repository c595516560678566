"""Repair of conversations: faults from windows, then the cheapest edits to a legal order of roles, folded over sorted turns.

A legal conversation's role initials match (s?(ua)+)? . What has been kept so far is in one of four states: nothing,
system only, last a user, last an assistant. A fold over turns carries the cheapest (cost, audit) into each state.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import BLANKS, in_arrow, looked_up, released, stored

RETAG, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Cost of a state that can't be reached.
NEVER = 1 << 50
#: Turns of a chunk, and how many chunks are joined at once.
CHUNK, FAN = 256, 64
LEGAL = ("su", "ua", "au")
#: Place of a row within its task, in what monotonically_increasing_id gives.
_PLACE = (1 << 33) - 1
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


#: The four states as fields of a struct, each a struct of cost c and audit a.
_FIELDS = "esua"


def _plus(state: str, cost: str | int, letter: str) -> str:
    return f"named_struct('c', {state}.c + {cost}, 'a', concat({state}.a, {letter}))"


def _states(e: str, s: str, u: str, a: str) -> str:
    return f"named_struct('e', {e}, 's', {s}, 'u', {u}, 'a', {a})"


def _with_insertion(x: str) -> str:
    """The four states, after one turn of an empty text has been put in where that is cheaper. Two in a row never are."""
    put = {k: _plus(f"{x}.{k}", INSERT, "'I'") for k in _FIELDS}
    return _states(f"{x}.e", f"{x}.s", f"least({x}.u, {put['e']}, {put['s']}, {put['a']})", f"least({x}.a, {put['u']})")


def _after(states: str, turn: str) -> str:
    """The four states after a turn: (initial, fault)."""
    kept = f"(CASE WHEN {turn}.fault IN ('blank', 'duplicate') THEN {NEVER} WHEN {turn}.fault = 'truncated' THEN {CUT_OFF} ELSE 0 END)"

    def to(state: str, letter: str) -> str:
        """Kept where its initial is the letter, or else given the role."""
        return _plus(state, f"{kept} + if({turn}.initial = '{letter}', 0, {RETAG})", f"if({turn}.initial = '{letter}', 'K', 'R')")

    gone = {k: _plus(f"x.{k}", DELETE, "'D'") for k in _FIELDS}
    system = _plus("x.e", f"if({turn}.initial = 's', {kept}, {NEVER})", "'K'")
    moved = _states(gone["e"], f"least({gone['s']}, {system})", f"least({gone['u']}, {to('least(x.e, x.s, x.a)', 'u')})", f"least({gone['a']}, {to('x.u', 'a')})")
    return f"element_at(transform(array({_with_insertion(states)}), x -> {moved}), 1)"


def _from(start: str) -> str:
    return _states(*[f"named_struct('c', if({start} = {i}, 0L, {NEVER}L), 'a', '')" for i in range(4)])


def _joined(states: str, chunk: str) -> str:
    """The four states after a chunk, from those before it: chunk[i] has the four states after it from state i."""
    through = lambda i, k: f"named_struct('c', {states}.{_FIELDS[i]}.c + {chunk}[{i}].{k}.c, 'a', concat({states}.{_FIELDS[i]}.a, {chunk}[{i}].{k}.a))"
    return _states(*[f"least({', '.join(through(i, k) for i in range(4))})" for k in _FIELDS])


def turns_of(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(_conv, _turn, _role, _text, _key, _at, _initial, _fault), stored: what the repair reads. _key names conversation, role and text; _at tells equal rows apart."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), one(role_col).alias("_role"), one(text_col).alias("_text"))
    key = F.md5(F.concat_ws("\x00", one("_conv"), F.length("_role").cast("string"), "_role", "_text"))
    last = F.regexp_extract("_text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    return stored(rows.withColumns({"_key": key, "_initial": F.substring("_role", 1, 1), "_fault": fault}).withColumn("_at", F.monotonically_increasing_id()), "turns")


def plans(turns: DataFrame) -> DataFrame:
    """One row for each conversation of turns_of(): _conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Only keys, initials and faults move. Rows are dealt by range of (conversation, turn), so one conversation may lie in
    many tasks; chunks of CHUNK turns are folded from every state that they may begin in, and the results joined, FAN at a
    time. Equal roles and texts of a conversation are looked up by first place: frequent ones by broadcast.
    """
    total = turns.count()
    order = F.struct(F.col("_turn").isNotNull().alias("some"), F.col("_turn").alias("turn"), F.col("_at").alias("at"))
    light = turns.select("_conv", "_turn", "_key", "_at", "_initial", "_fault")
    first = stored(light.groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "first-turns")
    seen = F.col("_first").isNotNull() & ~((F.col("_first.at") == F.col("_at")))
    rows = looked_up(light, first, "_key", "_n", total).select("_conv", "_turn", "_key", "_at", F.struct(F.col("_initial").alias("initial"), F.when(F.col("_fault") == "blank", "blank").when(seen, "duplicate").otherwise(F.col("_fault")).alias("fault")).alias("_t"))
    by = ["_conv", "_turn", "_key", "_at"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # The first conversation of a task may have begun in the one before.
    rows = rows.withColumns({"_part": F.spark_partition_id().cast("long"), "_head": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)) == 0})
    part, own = Window.partitionBy("_conv", "_part"), Window.partitionBy("_conv", "_part").orderBy(*by[1:])
    before = F.lag("_t.initial").over(own)
    place = F.row_number().over(own) - 1
    rows = rows.select(
        "_conv", "_part", "_t", "_turn", place.alias("_place"), F.max("_head").over(part).alias("_goes_on"),
        (before.isNotNull() & ~F.concat(before, F.col("_t.initial")).isin(*LEGAL)).cast("long").alias("_illegal"),
        (F.col("_turn").isNotNull() & ~F.col("_turn").eqNullSafe(F.lag("_turn").over(own))).cast("long").alias("_new"),
    )
    chunk = F.floor(F.col("_place") / CHUNK).cast("long")
    counted = lambda kind: F.sum((F.coalesce(F.col("_t.fault"), F.lit("")) == kind).cast("long")).alias(kind)
    ends = lambda by, c: by(F.struct(F.col("_t.initial").alias("initial"), F.col("_turn").alias("turn")), c)
    chunks = rows.groupBy("_conv", "_part", chunk.alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct("_place", "_t"))).alias("_turns"), F.max("_goes_on").alias("_goes_on"),
        *[counted(k) for k in _COUNTS[:3]], F.sum("_illegal").alias("illegal"), F.sum("_new").alias("turns"), F.max("_turn").alias("high"), F.min("_turn").alias("low"),
        ends(F.min_by, "_place").alias("first"), ends(F.max_by, "_place").alias("last"),
    )
    # From the conversation's beginning there is one way to start, elsewhere there are four.
    folded = f"transform(sequence(0, if(_goes_on OR _chunk > 0, 3, 0)), i -> aggregate(_turns, {_from('i')}, (s, t) -> {_after('s', 't._t')}))"
    chunks = chunks.withColumn("_paths", F.expr(folded)).drop("_turns", "_goes_on")
    # What lies in one task first, then across tasks.
    chunks = _combined(chunks, ["_conv", "_part", f"_chunk div {FAN} AS _chunk"])
    chunks = _combined(chunks, ["_conv", "_part", "0L AS _chunk"])
    chunks = _combined(chunks, ["_conv", f"_part div {FAN} AS _part", "0L AS _chunk"])
    chunks = _combined(chunks, ["_conv", "0L AS _part", "0L AS _chunk"])
    chosen = F.expr(f"element_at(transform(array({_with_insertion('_paths[0]')}), x -> least(x.e, x.a)), 1)")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return chunks.select("_conv", gaps.alias("gaps"), *_COUNTS, chosen["c"].alias("cost"), chosen["a"].alias("audit"))


def _combined(chunks: DataFrame, groups: list[str]) -> DataFrame:
    """Chunks of a group as one, in the order of (_part, _chunk)."""
    values = ["_part", "_chunk", "_paths", *_COUNTS, "turns", "high", "low", "first", "last"]
    some = chunks.groupBy(*[F.expr(g) for g in groups]).agg(F.array_sort(F.collect_list(F.struct(F.struct("_part", "_chunk").alias("at"), *values))).alias("_all"))
    # Windows see the rows of one task, so the seams between tasks are looked at here.
    seams = "filter(zip_with(slice(_all, 1, size(_all) - 1), slice(_all, 2, size(_all)), (a, b) -> named_struct('a', a.last, 'b', b.first, 'seam', a._part <> b._part)), s -> s.seam)"
    legal = ", ".join(f"'{x}'" for x in LEGAL)
    total = lambda c: f"aggregate(_all, 0L, (n, x) -> n + x.{c})"
    out = {
        "_paths": f"transform(sequence(0, size(_all[0]._paths) - 1), i -> aggregate(slice(_all, 2, size(_all)), _all[0]._paths[i], (s, x) -> {_joined('s', 'x._paths')}))",
        **{c: total(c) for c in _COUNTS[:3]},
        "illegal": f"{total('illegal')} + size(filter({seams}, s -> concat(s.a.initial, s.b.initial) NOT IN ({legal})))",
        "turns": f"{total('turns')} - size(filter({seams}, s -> s.a.turn IS NOT NULL AND s.a.turn <=> s.b.turn))",
        "high": "array_max(_all.high)", "low": "array_min(_all.low)", "first": "_all[0].first", "last": "element_at(_all, -1).last",
    }
    kept = [c.split(" AS ")[-1] for c in groups]
    return some.selectExpr(*kept, *[f"{v} AS {c}" for c, v in out.items()])


class Walk:
    """Goes through a conversation's audit turn by turn; gives the (edit, role, text) that stay."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _next(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = self._next()
            self.last = role[0]
            yield "I", role, ""

    def turn(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = role if edit == "K" else self._next()
            self.last = role[:1]
            yield edit, role, text

    def end(self):
        yield from self._inserted()


def _walked(turns: DataFrame, found: DataFrame, each, schema: str, columns: list[str]) -> DataFrame:
    """Rows made by each(summary row, iterator of what stays) of every conversation: a stream over rows sorted by conversation, its summary first."""
    summary = [c for c in found.columns if c != "_conv"]
    rows = turns.select("_conv", F.lit(1).alias("_kind"), "_turn", "_key", "_at", "_role", "_text", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in summary])
    heads = found.select("_conv", F.lit(0).alias("_kind"), *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("_turn", "_key", "_at", "_role", "_text")], *summary)
    order = ["_conv", "_kind", "_turn", "_key", "_at"]
    both = heads.unionByName(rows).repartition("_conv").sortWithinPartitions(*order).select("_conv", "_kind", "_role", "_text", *summary)

    def run(batches):
        state = None
        for batch in released(batches):
            out: list[list] = [[] for _ in columns]

            def put(made, out=out):
                for row in made:
                    for c, x in zip(out, row, strict=True):
                        c.append(x)

            kinds, roles, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if state is not None:
                        put(state.end())
                    state = each(batch.column(0)[i].as_py(), {c: batch.column(4 + n)[i].as_py() for n, c in enumerate(summary)})
                else:
                    put(state.turn(roles[i], texts[i]))
            if out[0]:
                yield _batch(out)
        if state is not None:
            out = [[] for _ in columns]
            for row in state.end():
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            if out[0]:
                yield _batch(out)

    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    kinds = [types[x.strip().split()[-1]] for x in schema.split(",")]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], columns)

    return both.transform(in_arrow, run, schema)


class _Rows:
    """The turns of a repaired conversation: (conversation, place, role, text, edit)."""

    def __init__(self, conv, summary: dict):
        self.conv, self.walk, self.place = conv, Walk(summary["audit"]), 0

    def _out(self, made):
        for edit, role, text in made:
            yield self.conv, self.place, role, text, edit
            self.place += 1

    def turn(self, role: str, text: str):
        return self._out(self.walk.turn(role, text))

    def end(self):
        return self._out(self.walk.end())


class _Digest:
    """One row of a conversation: its summary and the sha256 of its repaired text, taken as the turns go by."""

    def __init__(self, conv, summary: dict):
        self.row, self.walk, self.hash, self.any = (conv, *summary.values()), Walk(summary["audit"]), hashlib.sha256(), False

    def _take(self, made) -> None:
        for _, role, text in made:
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def turn(self, role: str, text: str):
        self._take(self.walk.turn(role, text))
        return ()

    def end(self):
        self._take(self.walk.end())
        yield (*self.row, self.hash.hexdigest())


def _kind(turns: DataFrame) -> str:
    return turns.schema["_conv"].dataType.simpleString()


def repaired_turns(df: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations: conv_id, place, role, text, edit (K kept, R given another role, I put in), a row for each turn.

    columns: conv_col, turn_col, role_col, text_col. Null roles and texts are one space. Turns come by number, nulls
    first, ties by role and text. A null conversation is one of its own. No rows: no rows. Other columns aren't read.
    """
    turns = turns_of(df, **columns)
    return _walked(turns, plans(turns).select("_conv", "audit"), _Rows, f"conv_id {_kind(turns)}, place bigint, role string, text string, edit string", ["conv_id", "place", "role", "text", "edit"])


def repair(df: DataFrame, **columns: str) -> DataFrame:
    """One row for each conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A turn's first fault counts: blank (nothing but blanks), duplicate (role and text came before), truncated (doesn't end
    with . ! or ?). Blank and duplicate turns go (D, 2 each); others stay (K), get the role user or assistant (R, 1) or go;
    empty turns are put in (I, 5); a truncated turn that stays costs 5. audit has the letters of the cheapest edits to role
    initials (s?(ua)+)?, of equally cheap ones the ASCII-least. A role without a letter never stays as it is.

    Faults and folds move keys and initials only; texts are shuffled once, for the digest, and stream through a task, so
    memory is that of a batch and of the conversation's audit (a letter a turn). A digest needs its conversation in one
    task. Nulls, ties and other columns: as repaired_turns says. No rows: no rows.
    """
    turns = turns_of(df, **columns)
    names = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    schema = f"conv_id {_kind(turns)}, " + ", ".join(f"{c} bigint" for c in names[1:-2]) + ", audit string, repaired_sha256 string"
    return _walked(turns, plans(turns), _Digest, schema, names)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults put in, by crc32 of conv_id:turn modulo 20 (nulls: one space): 0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 sets role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    rows = df.select("conv_id", "turn", "role", "text", which.alias("_d")).where("_d <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), "_d")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_d", "_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair(damaged(conversations)) for every conversation, those without a row left too: zeros, an empty audit and the digest of nothing."""
    found = repair(damaged(conversations))
    all_of = conversations.select(F.col("conv_id").alias("_c")).distinct()
    out = all_of.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    zeros = reduce(lambda d, c: d.withColumn(c, F.coalesce(c, F.lit(0).cast("long"))), ["gaps", *_COUNTS, "cost"], out)
    return zeros.select(F.col("_c").alias("conv_id"), "gaps", *_COUNTS, "cost", F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
