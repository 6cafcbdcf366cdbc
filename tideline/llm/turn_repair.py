"""Repair of the order of roles in conversations by cheapest edits: a dynamic programme over turns as NumPy tensors.

Turns of a conversation are kept, given another role, deleted or inserted, so that their role initials read `(s?(ua)+)?`. That
language has four states, so what a run of turns can do is a matrix of 4 x 4 costs, from the state before it to the one behind it.
Turns are dealt to sorted ranges of (conversation, turn) and cut into pieces of bounded length; a conversation of any length is a row of
pieces that lie in several tasks. Three passes, each over all pieces of a batch at once, in buckets of like length, time outermost:

1. costs of each piece, backwards, for every state it may end in;
2. costs behind each piece, by folding the matrices of its conversation from the end (array functions, 16 numbers a piece);
3. edits of each piece, forwards along the stored backward costs, and from them the repaired turns.

Of edits that cost the same the string that is least in ASCII order is taken: at each step the smallest letter that keeps the cost.

Defined results: a null role or text counts as one space; turns are ordered null first, equal turns by role, then by a hash of the text; a
null conversation id is a conversation like any other; repeated rows are rows of their own; other columns are left alone; of an empty table nothing
is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_width

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns in a piece at most, characters of text in it about, and cells of a tensor at most.
PIECE, PIECE_CHARS, CELLS = 512, 4 << 20, 1 << 20
NEVER = 1 << 28
#: States by what was written last: nothing, system, user, assistant. Rows: state behind a turn whose role begins with s, u, a or another
#: letter (4 is none), and behind an inserted turn.
AFTER = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
INSERTED = np.array([2, 2, 3, 2])
#: Cost of what must be inserted at the end.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
BLANK, REPEATED, CUT = 1, 2, 3
_SPACE, _NOT_SPACE = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, cut, repeated or given to the user, by a hash of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    own = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), "kind")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def faulty(turns: DataFrame) -> DataFrame:
    """Add `fault`, the first of a turn (0 none, BLANK, REPEATED, CUT), and what orders turns.

    Where texts of a conversation are equal, the least of them is found by a partial aggregate over hashes, not by bringing them together."""
    # where a row was read tells equal rows apart, which may stand for each other
    known = turns.withColumn("late", F.col("turn").isNotNull()).withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(7), "text")).withColumn("row", F.monotonically_increasing_id())
    first = known.groupBy("conv_id", "role", "h", "g").agg(F.min(F.struct("late", "turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = first.select(F.col("conv_id").alias("conv"), F.col("role").alias("same_role"), F.col("h").alias("same_h"), F.col("g").alias("same_g"), "first")
    both = known.join(same, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("same_role")) & (F.col("h") == F.col("same_h")) & (F.col("g") == F.col("same_g")), "left")
    repeated = F.coalesce(F.struct("late", "turn", "row") != F.col("first"), F.lit(False))
    fault = F.when(~F.col("text").rlike(_NOT_SPACE), BLANK).when(repeated, REPEATED).when(~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z"), CUT).otherwise(0)
    return both.select("conv_id", "late", "turn", "role", "text", "h", "g", "row", fault.alias("fault"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted turns into pieces: at another conversation, at PIECE turns or PIECE_CHARS characters, and where a batch ends."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        conv, turn, role, text, code = batch.columns
        ids = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change = np.append(True, ids[1:] != ids[:-1])
        begin = np.flatnonzero(change)
        within = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        chars = np.array([len(x) for x in text.to_pylist()], np.int64)
        block = np.cumsum(chars) // PIECE_CHARS
        change |= (within % PIECE == 0) | np.append(True, block[1:] != block[:-1])
        begin = np.flatnonzero(change)
        offsets = pa.array(np.append(begin, n).astype(np.int32))
        codes = code.to_numpy(zero_copy_only=False).astype(np.int64)
        kind = codes & 3
        wrong = ~(((kind[:-1] == 0) & (kind[1:] == 1)) | ((kind[:-1] == 1) & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))) & ~change[1:]
        illegal = np.add.reduceat(np.append(0, wrong.astype(np.int64)), begin)
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (turn, role, text, code)]
        last = np.append(begin[1:], n) - 1
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(begin)), pa.array(np.full(len(begin), part, np.int32)), pa.array(k + np.arange(len(begin))), *lists, pa.array(illegal), pa.array(kind[begin].astype(np.int32)), pa.array(kind[last].astype(np.int32))],
            names=["conv_id", "part", "k", "turns", "roles", "texts", "codes", "illegal", "first_kind", "last_kind"],
        )
        k += len(begin)


def pieces(turns: DataFrame) -> DataFrame:
    """Turns (see `faulty`) as a table of pieces in order: (conv_id, part, k, turns, roles, texts, codes, illegal, first_kind, last_kind).

    The code of a turn is the kind of its role (0 to 3) plus 4 times its fault."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    order = [F.asc_nulls_first("conv_id"), "late", "turn", "role", "h", "g", "row"]
    sorted_turns = turns.withColumn("code", (kind + 4 * F.col("fault")).cast("int")).repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    fields = f"conv_id {conv}, part int, k bigint, turns array<{turn}>, roles array<string>, texts array<string>, codes array<int>, illegal bigint, first_kind int, last_kind int"
    return sorted_turns.select("conv_id", "turn", "role", "text", "code").mapInArrow(_pieces, fields)


def backward(codes: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (time + 1, pieces, 4, ends) to go on from each state before each turn, the turns' codes given as (time, pieces); `end` is
    (pieces, 4, ends), the costs behind the last turn."""
    time, n = codes.shape
    out = np.empty((time + 1, *end.shape), np.int32)
    out[time] = end
    for t in range(time - 1, -1, -1):
        ahead = np.concatenate([out[t + 1], np.full((n, 1, end.shape[2]), NEVER, np.int32)], axis=1)
        kind, fault = codes[t] & 3, codes[t] >> 2
        stays = ((fault == BLANK) | (fault == REPEATED)) * NEVER + (fault == CUT) * TRUNCATED
        kept = ahead[np.arange(n)[:, None], AFTER.T[kind]] + (stays + KEEP)[:, None, None]
        own = np.minimum(np.minimum(DELETE + ahead[:, :4], kept), ahead[:, INSERTED] + (stays + REROLE)[:, None, None])
        own = np.minimum(own, np.minimum(INSERT + own[:, INSERTED], 2 * INSERT + own[:, INSERTED[INSERTED]]))
        out[t] = np.where((t < length)[:, None, None], np.minimum(own, NEVER), out[t + 1])
    return out


def forward(codes: np.ndarray, length: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, state behind the last turn): letters are (pieces, time, 3), two places for insertions before a turn and one for the turn
    itself, 0 where there is none; costs are (time + 1, pieces, 4)."""
    time, n = codes.shape
    letters, every = np.zeros((n, time, 3), np.uint8), np.arange(n)
    for t in range(time):
        live, kind, fault = t < length, codes[t] & 3, codes[t] >> 2
        ahead = np.concatenate([costs[t + 1], np.full((n, 1), 4 * NEVER, np.int32)], axis=1)
        for place in (0, 1):
            now = costs[t, every, state]
            gone = DELETE + ahead[every, state] == now
            insert = live & ~gone & (INSERT + costs[t, every, INSERTED[state]] == now)
            letters[:, t, place] = np.where(insert, ord("I"), 0)
            state = np.where(insert, INSERTED[state], state)
        now = costs[t, every, state]
        gone = DELETE + ahead[every, state] == now
        may_stay = (fault != BLANK) & (fault != REPEATED)
        kept = may_stay & (ahead[every, AFTER[state, kind]] + KEEP + (fault == CUT) * TRUNCATED == now)
        letters[:, t, 2] = np.where(live, np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R"))), 0)
        state = np.where(live & ~gone, np.where(kept, AFTER[state, kind], INSERTED[state]), state)
    return letters, state


def _buckets(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, codes as (time, rows), lengths) by powers of two of the length, and by CELLS."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    length = np.diff(at)
    width = np.int64(1) << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for lo in range(0, len(rows), max(1, CELLS // int(w))):
            own = rows[lo : lo + max(1, CELLS // int(w))]
            place = np.minimum(at[own][:, None] + np.arange(w), max(len(flat) - 1, 0))
            yield own, flat[place].T.astype(np.int64), length[own]


def _costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int32)
    for batch in batches:
        out = np.empty((len(batch), 16), np.int32)
        for rows, codes, length in _buckets(batch.column(3)):
            out[rows] = backward(codes, length, np.broadcast_to(ends, (len(rows), 4, 4)))[0].reshape(len(rows), 16)
        costs = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * 16), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], costs], names=["conv_id", "part", "k", "costs"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each piece for every state it may be entered in, and the state it is left in."""
    for batch in batches:
        n = len(batch)
        behind = batch.column(4).values.to_numpy(zero_copy_only=False)[batch.column(4).offsets.to_numpy()[:-1, None] + np.arange(4)].astype(np.int32)
        left, edits = np.zeros((n, 4), np.int32), np.empty((n, 4), object)
        for rows, codes, length in _buckets(batch.column(3)):
            costs = backward(codes, length, behind[rows][:, :, None])[..., 0]
            for state in range(4):
                letters, last = forward(codes, length, costs, np.full(len(rows), state))
                left[rows, state] = last
                for i, row in enumerate(rows):
                    edits[row, state] = letters[i, : length[i]].tobytes()
        as_lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), pa.array(x.ravel().tolist(), kind))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], as_lists(left, pa.int32()), as_lists(edits, pa.binary())], names=["conv_id", "part", "k", "left", "edits"])


def _folded(costed: DataFrame) -> DataFrame:
    """(conv_id, cost, pieces): costs of a conversation, and of each of its pieces (part, k) what stands behind it by state."""
    numbers = F.array(*[F.lit(i) for i in range(4)])
    through = lambda piece, after: F.transform(numbers, lambda s: F.array_min(F.transform(numbers, lambda e: F.element_at(piece["costs"], s * 4 + e + 1) + F.element_at(after, e + 1))))
    per = costed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "k", "costs")), asc=False).alias("all"))
    start = F.struct(F.array(*[F.lit(int(x)) for x in AT_END]).alias("after"), F.array().cast("array<struct<part:int,k:bigint,behind:array<int>>>").alias("done"))
    folded = F.aggregate("all", start, lambda s, p: F.struct(through(p, s["after"]).alias("after"), F.concat(s["done"], F.array(F.struct(p["part"].alias("part"), p["k"].alias("k"), s["after"].alias("behind")))).alias("done")))
    return per.select("conv_id", folded.alias("x")).select("conv_id", F.element_at("x.after", 1).cast("bigint").alias("cost"), F.col("x.done").alias("pieces"))


def _entered(traced: DataFrame) -> DataFrame:
    """(conv_id, part, k, enter, leave, final): the state before and behind each piece; `final` marks the last one of a conversation."""
    per = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "k", "left"))).alias("all"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<part:int,k:bigint,enter:int,leave:int>>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        leave = F.element_at(p["left"], s["state"] + 1)
        return F.struct(leave.alias("state"), F.concat(s["done"], F.array(F.struct(p["part"].alias("part"), p["k"].alias("k"), s["state"].alias("enter"), leave.alias("leave")))).alias("done"))

    folded = per.select("conv_id", F.size("all").alias("n"), F.aggregate("all", start, step, lambda s: s["done"]).alias("done"))
    each = folded.select("conv_id", "n", F.posexplode("done").alias("place", "x"))
    return each.select(F.col("x.part").alias("part"), F.col("x.k").alias("k"), F.col("x.enter").alias("enter"), F.col("x.leave").alias("leave"), (F.col("place") == F.col("n") - 1).alias("final"))


def repair(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with edits, (conv_id, cost)) of a written table of pieces.

    Edited pieces are (conv_id, part, k, enter, leave, final, edits, turns, roles, texts); `edits` has three bytes for each turn. A piece is
    known by (part, k), so rows of one conversation are only brought together as 16 numbers a piece."""
    costed = cut.select("conv_id", "part", "k", "codes").mapInArrow(_costed, f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, part int, k bigint, costs array<int>")
    folded = checkpoint(_folded(costed))
    behind = folded.select(F.inline("pieces"))
    traced = cut.select("conv_id", "part", "k", "codes").join(behind, ["part", "k"]).select("conv_id", "part", "k", "codes", "behind")
    traced = checkpoint(traced.mapInArrow(_traced, f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, part int, k bigint, left array<int>, edits array<binary>"))
    edited = traced.select("part", "k", "edits").join(_entered(traced), ["part", "k"]).select("part", "k", "enter", "leave", "final", F.element_at("edits", F.col("enter") + 1).alias("edits"))
    return cut.select("conv_id", "part", "k", "turns", "roles", "texts").join(edited, ["part", "k"]), folded.select("conv_id", "cost")


def _edited(enter: int, leave: int, final: bool, edits: bytes, turns: list, roles: list, texts: list) -> Iterator[tuple[str, object, str, str]]:
    """(edit, turn, role, text) of a piece, deletions among them."""
    last = " sua"[enter]
    for i, (turn, role, text) in enumerate(zip(turns, roles, texts, strict=True)):
        for letter in edits[3 * i : 3 * i + 3]:
            if letter:
                edit = chr(letter)
                if edit in "IR":
                    role_now = "assistant" if last == "u" else "user"
                    last = role_now[0]
                    yield (edit, None, role_now, "") if edit == "I" else (edit, turn, role_now, text)
                else:
                    last = role[:1] if edit == "K" else last
                    yield edit, turn, role, text
    if final:
        for role_now in (("user", "assistant"), ("assistant",))[leave - 1] if leave in (1, 2) else ():
            yield "I", None, role_now, ""


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.to_pylist():
            rows = list(_edited(*[piece[c] for c in ("enter", "leave", "final", "edits", "turns", "roles", "texts")]))
            n = len(rows)
            columns = [pa.array([piece["conv_id"]] * n, batch.schema.field("conv_id").type), pa.array([piece["part"]] * n, pa.int32()), pa.array([piece["k"]] * n, pa.int64()), pa.array(range(n), pa.int32())]
            kinds = (pa.string(), batch.schema.field("turns").type.value_type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["conv_id", "part", "k", "place", "edit", "turn", "role", "text"])


def repaired_turns(edited: DataFrame) -> DataFrame:
    """(conv_id, part, k, place, edit, turn, role, text) of all turns after repair, in order of part, k and place; deleted ones carry D."""
    conv, turn = edited.schema["conv_id"].dataType.simpleString(), edited.schema["turns"].dataType.elementType.simpleString()
    return edited.mapInArrow(_turn_rows, f"conv_id {conv}, part int, k bigint, place int, edit string, turn {turn}, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation, of sorted pieces, one turn after the other."""
    names = ["conv_id", "audit", "repaired_sha256"]
    audit, digest, now, some, empty, kind = [], hashlib.sha256(), None, False, True, None
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if not some or piece["conv_id"] != now:
                if some:
                    out.append((now, "".join(audit), digest.hexdigest()))
                audit, digest, now, some, empty = [], hashlib.sha256(), piece["conv_id"], True, True
            for edit, _, role, text in _edited(*[piece[c] for c in ("enter", "leave", "final", "edits", "turns", "roles", "texts")]):
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), *[pa.array([r[i] for r in out], pa.string()) for i in (1, 2)]], names=names)
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=names)


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256). A hash takes one turn after the other, so a conversation's pieces pass through one task here, but
    none is kept there."""
    order = ["conv_id", "part", "k"]
    pieces_in_order = edited.repartition(shuffle_width(edited.sparkSession), "conv_id").sortWithinPartitions(*order)
    return pieces_in_order.mapInArrow(_digests, f"conv_id {edited.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of all conversations after damage."""
    rows = faulty(damaged(turns))
    cut = checkpoint(pieces(rows))
    edited, costs = repair(cut)
    fault = lambda k: F.aggregate("codes", F.lit(0).cast("bigint"), lambda s, c: s + (F.floor(c / 4) == k).cast("bigint"))
    # the same turn may be in neighbouring pieces
    own = cut.select("conv_id", F.array_distinct(F.filter("turns", lambda t: t.isNotNull())).alias("turns"), *[fault(k).alias(name) for k, name in ((BLANK, "blank"), (REPEATED, "duplicate"), (CUT, "truncated"))])
    counts = own.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    distinct = own.select("conv_id", F.explode("turns").alias("turn")).distinct()
    spans = distinct.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("bigint").alias("gaps"))
    ends = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "k", "first_kind", "last_kind"))).alias("p"), F.sum("illegal").alias("inside"))
    wrong = lambda a, b: ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))
    borders = F.aggregate(F.sequence(F.lit(2), F.size("p")), F.lit(0).cast("bigint"), lambda s, i: s + wrong(F.element_at("p", i - 1)["last_kind"], F.element_at("p", i)["first_kind"]).cast("bigint"))
    illegal = ends.select("conv_id", (F.col("inside") + F.when(F.size("p") > 1, borders).otherwise(0)).alias("illegal"))
    out = turns.select("conv_id").distinct()
    for k, more in enumerate((counts, spans, illegal, costs, digests(edited))):
        renamed = more.withColumnRenamed("conv_id", f"conv_{k}")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col(f"conv_{k}")), "left").drop(f"conv_{k}")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
