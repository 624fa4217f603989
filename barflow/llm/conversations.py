"""Repair of conversation structure by a dynamic program over turns, many conversations at a time.

A repaired conversation's roles read `(s?(ua)+)?` by their initials: perhaps a
system turn, then users and assistants in turn.  Rows may be kept (0), given
another role (1) or deleted (2), and empty turns may be inserted (5); a
truncated row that stays costs 5 more, blank and repeated rows must go.  Four
states say what may follow: nothing so far, after s, after u, after a.

Conversations are bucketed by length and laid out time-major: one NumPy pass a
turn updates the cost-to-go of all states of all conversations of a bucket, the
costs are stored, and all edits are traced forward together, least letter
(Delete < Insert < Keep < Rerole) among the cheapest first, which makes each
audit the ASCII-least of the cheapest.

Conversations up to LONG_ROWS rows and LONG_BYTES bytes of text are shuffled
whole and repaired in one pass.  Longer ones, counted first, are dealt by range
into pieces that follow each other: the pieces' costs between all pairs of
states (least-plus matrices) are composed from the end to give each piece the
cost-to-go behind it, the states that its tracing leads to are composed from
the start, and each piece is traced by its own task.  Only one small row a
piece meets in one group.  The hash of a long conversation is taken piece by
piece by one task, as the hash of a sequence must be, in bounded memory.

Defined results: nulls in role and text are one space, so such texts are blank
and such roles fit nowhere; rows of one turn follow each other by role, then
text; repeated rows are repeats of each other; null turns come first; rows with
a null conv_id are one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_broadcast

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows and text bytes from which a conversation is repaired in pieces, and those of a piece.
LONG_ROWS, LONG_BYTES = 8192, 8 << 20
#: Text bytes and rows that one task repairs together (one conversation at least).
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1 << 15
#: Cells (turns x conversations) of one tensor.
CELLS = 1 << 18

SPACE = " \t\n\v\f\r"
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
START, SYSTEM, USER, ASSISTANT, NOWHERE = range(5)
#: State after a kept row: by state, then initial (s, u, a, other).
NEXT = np.array([[SYSTEM, USER, NOWHERE, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE], [NOWHERE, NOWHERE, ASSISTANT, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE]])
#: State after an inserted row or one with another role.
FILL = np.array([USER, USER, ASSISTANT, USER])
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
FAR = np.int64(1) << 60
LEGAL = {"su", "ua", "au"}

TURNS = "array<struct<role: string, text: string>>"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of damaged conversations; the damage follows from crc32 of conv_id:turn."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"))


# ---- the dynamic program


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs (conversations x states x ends) with up to two inserted turns before the next row."""
    return np.minimum(cost, np.minimum(cost[:, FILL] + INSERT, cost[:, FILL[FILL]] + 2 * INSERT))


def _choices(after: np.ndarray, initial: np.ndarray, fault: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling one row of each conversation, by state, from the costs after it."""
    stays = np.where(fault == CUT_OFF, TRUNCATED, np.where(fault == FINE, 0, FAR))[:, None, None]
    wall = np.concatenate([after, np.full_like(after[:, :1], FAR)], axis=1)
    kept = np.take_along_axis(wall, NEXT.T[initial][:, :, None], axis=1) + KEEP + stays
    return after + (DELETE * weight)[:, None, None], kept, after[:, FILL] + REROLE + stays


def costs_to_go(initial: np.ndarray, fault: np.ndarray, weight: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1) x conversations x states x ends; the first three by turn, then conversation; rows beyond a length are void."""
    out = np.empty((len(initial) + 1, *end.shape), np.int64)
    out[-1] = closed(end)
    for t in range(len(initial) - 1, -1, -1):
        cost = closed(np.minimum.reduce(_choices(out[t + 1], initial[t], fault[t], weight[t])))
        out[t] = np.where((t < length)[:, None, None], np.minimum(cost, FAR), out[t + 1])
    return out


def trace(cost: np.ndarray, initial: np.ndarray, fault: np.ndarray, weight: np.ndarray, length: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and the states after them, (turns + 1) x 3 places x conversations (0: none), and the last states.

    Before each row there is room for two inserted turns; last: conversations
    that end here, and so may have turns inserted after their last row.
    """
    turns, n = initial.shape
    letters, states = np.zeros((turns + 1, 3, n), np.uint8), np.zeros((turns + 1, 3, n), np.uint8)
    lane, state = np.arange(n), state.copy()
    for t in range(turns + 1):
        at_end = t == length
        alive = (t < length) | (at_end & last)
        here = cost[t, :, :, 0]
        if t < turns:
            gone, kept, other = (c[:, :, 0] for c in _choices(cost[t + 1], initial[t], fault[t], weight[t]))
        for place in range(2):
            done = at_end & (here[lane, state] == 0) if t == turns else np.where(at_end, here[lane, state] == 0, gone[lane, state] == here[lane, state])
            put = alive & ~done & (here[lane, FILL[state]] + INSERT == here[lane, state])
            state = np.where(put, FILL[state], state)
            letters[t, place], states[t, place] = np.where(put, ord("I"), 0), state
        if t == turns:
            break
        row = t < length
        d = row & (gone[lane, state] == here[lane, state])
        k = row & ~d & (kept[lane, state] == here[lane, state])
        r = row & ~d & ~k
        state = np.where(k, NEXT[state, initial[t]], np.where(r, FILL[state], state))
        letters[t, 2], states[t, 2] = np.select([d, k, r], [ord("D"), ord("K"), ord("R")], 0), state
    return letters, states, state


# ---- rows of conversations as arrays


class Lanes:
    """Consecutive rows of one or more conversations (or pieces): entries of one row each, copies beyond the first as one entry more."""

    def __init__(self, rows: pa.Table, keys: list[str]):
        self.rows, n = rows, rows.num_rows
        keyed = [rows.column(c).to_pylist() for c in keys]
        begins = [i for i in range(n) if i == 0 or any(k[i] != k[i - 1] for k in keyed)]
        self.keys = [[k[i] for i in begins] for k in keyed]
        self.row_edges = [*begins, n]
        turns, roles, texts, copies = (rows.column(c).to_pylist() for c in ("turn", "role", "text", "copies"))
        known = rows.column("first").to_pylist() if "first" in rows.column_names else None
        source, initial, fault, weight, edges = [], [], [], [], [0]
        stats = []
        for a, b in zip(begins, self.row_edges[1:], strict=True):
            seen, counts, illegal, before, first = set(), [0, 0, 0, 0], 0, None, None
            for i in range(a, b):
                if not copies[i]:
                    continue
                role, text, m = roles[i], texts[i], copies[i]
                letter, body = role[:1], text.rstrip(SPACE)
                repeated = not known[i] if known else (role, text) in seen
                f = BLANK if not body else DUPLICATE if repeated else FINE if body[-1] in ".!?" else CUT_OFF
                seen.add((role, text))
                again = [] if m == 1 else [(f if f in (BLANK, DUPLICATE) else DUPLICATE, m - 1)]
                for g, w in [(f, 1), *again]:
                    counts[g] += w
                    source.append(i)
                    initial.append("sua".find(letter) if letter else -1)
                    fault.append(g)
                    weight.append(w)
                illegal += (before is not None and before + letter not in LEGAL) + (m - 1)
                first, before = letter if first is None else first, letter
            held = [turns[i] for i in range(a, b) if copies[i] and turns[i] is not None]
            stats.append((counts, illegal, first, before, held[0] if held else None, held[-1] if held else None, len(set(held))))
            edges.append(len(source))
        self.source, self.edges, self.stats = np.array(source, np.int64), np.array(edges, np.int64), stats
        self.initial, self.fault, self.weight = np.array(initial, np.int64), np.array(fault, np.int64), np.array(weight, np.int64)
        self.initial[self.initial < 0] = 3

    def __len__(self) -> int:
        return len(self.stats)

    def buckets(self, most: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Conversations of about one length: their numbers, initial, fault, weight and entry by turn, and their lengths."""
        length = np.diff(self.edges)
        size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for s in np.unique(size):
            alike = np.flatnonzero(size == s)
            step = max(1, most >> int(s))
            for x in range(0, len(alike), step):
                some = alike[x : x + step]
                at = np.arange(int(length[some].max(initial=0)))[:, None]
                entry = np.where(at < length[some], self.edges[some] + at, 0)
                of = (lambda a, e=entry: a[e]) if len(self.source) else (lambda a, e=entry: np.zeros(e.shape, np.int64))
                yield some, of(self.initial), of(self.fault), of(self.weight), entry, length[some]

    def traced(self, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[str], pa.Array]:
        """Cost, audit and repaired turns of each conversation, from its start state and the cost-to-go behind it."""
        n, cost = len(self), np.zeros(len(self), np.int64)
        parts = []
        for some, initial, fault, weight, entry, length in self.buckets():
            go = costs_to_go(initial, fault, weight, length, end[some][:, :, None])
            letters, states, _ = trace(go, initial, fault, weight, length, start[some], last[some])
            cost[some] = go[0, np.arange(len(some)), start[some], 0]
            turns, width = letters.shape[0], letters.shape[2]
            flat = letters.transpose(2, 0, 1).reshape(width, -1)
            lane, place = np.nonzero(flat)
            t = place // 3
            e = np.where((place % 3 == 2) & (t < turns - 1), entry[np.minimum(t, turns - 2), lane] if turns > 1 else 0, -1)
            parts.append((some[lane], flat[lane, place], states.transpose(2, 0, 1).reshape(width, -1)[lane, place], e))
        who, letter, state, e = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [[]] * 4))
        order = np.argsort(who, kind="stable")
        who, letter, state, e = who[order].astype(np.int64), letter[order].astype(np.uint8), state[order], e[order].astype(np.int64)
        weight = np.where(e >= 0, self.weight[e], 1) if len(self.weight) else np.ones(len(e), np.int64)
        audit = np.repeat(letter, weight).tobytes().decode()
        edge = np.concatenate([[0], np.cumsum(np.bincount(who, weights=weight, minlength=n).astype(np.int64))])
        audits = [audit[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        stays = letter != ord("D")
        who, letter, state, e = who[stays], letter[stays], state[stays], e[stays]
        given = pa.array(np.where(state == USER, "user", "assistant").astype(object), pa.string())
        row = pa.array(np.where(e >= 0, self.source[e] if len(self.source) else 0, 0), pa.int64(), mask=e < 0)
        role = pc.if_else(pa.array(letter == ord("K")), self.rows.column("role").combine_chunks().cast(pa.string()).take(row), given)
        text = pc.fill_null(self.rows.column("text").combine_chunks().cast(pa.string()).take(row), "")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype(np.int32)
        return cost, audits, pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([role, text], ["role", "text"]))


def _gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by the keys in tables of about BATCH_BYTES, none of which parts equal keys."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        step = max(1, min(BATCH_ROWS, BATCH_BYTES * b.num_rows // max(b.nbytes, 1)))
        for x in range(0, b.num_rows, step):
            part = b.slice(x, step)
            held.append(part)
            size, rows = size + part.nbytes, rows + part.num_rows
            if size < BATCH_BYTES and rows < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            keyed = [table.column(c) for c in keys]
            last, at = [k[-1].as_py() for k in keyed], table.num_rows - 1
            while at and all(k[at - 1].as_py() == v for k, v in zip(keyed, last, strict=True)):
                at -= 1
            if at:
                yield table.slice(0, at)
            held = table.slice(at).to_batches()
            size, rows = sum(h.nbytes for h in held), table.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _gathered(batches, ["conv_id"]):
        lanes = Lanes(rows, ["conv_id"])
        n = len(lanes)
        cost, audits, turns = lanes.traced(np.zeros(n, np.int64), np.tile(ENDS, (n, 1)), np.ones(n, bool))
        columns = [[s[5] - s[4] + 1 - s[6] if s[6] else 0 for s in lanes.stats], *[[s[0][f] for s in lanes.stats] for f in (BLANK, DUPLICATE, CUT_OFF)], [s[1] for s in lanes.stats], cost]
        yield pa.RecordBatch.from_arrays([pa.array(lanes.keys[0], rows.schema.field("conv_id").type), *[pa.array(c, pa.int64()) for c in columns], pa.array(audits, pa.string()), turns], names=["conv_id", *COUNTS, "audit", "turns"])


# ---- long conversations, piece by piece

_ORDER = ["conv_id", "turn", "role", "text"]
_MATRIX = "m array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, turn_min string, turn_max string, turns long"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece its costs from each state to each state, and counts."""
    own = np.where(np.eye(4, dtype=bool), 0, FAR)
    for rows in _gathered(batches, ["piece", "conv_id"]):
        lanes = Lanes(rows, ["piece", "conv_id"])
        m = np.zeros((len(lanes), 16), np.int64)
        for some, initial, fault, weight, _, length in lanes.buckets(CELLS // 4):
            m[some] = costs_to_go(initial, fault, weight, length, np.broadcast_to(own, (len(some), 4, 4)))[0].reshape(-1, 16)
        s = lanes.stats
        longs = [[x[0][f] for x in s] for f in (BLANK, DUPLICATE, CUT_OFF)] + [[x[1] for x in s]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(lanes.keys[1], rows.schema.field("conv_id").type), pa.array(lanes.keys[0], pa.int32()), pa.array(list(m), pa.list_(pa.int64())), *[pa.array(c, pa.int64()) for c in longs], *[pa.array([x[k] for x in s], pa.string()) for k in (2, 3)], *[pa.array([None if x[k] is None else str(x[k]) for x in s], pa.string()) for k in (4, 5)], pa.array([x[6] for x in s], pa.int64())],
            names=["conv_id", "piece", *[c.split()[0] for c in _MATRIX.split(", ")]],
        )


def _behind(rows):  # noqa: ANN001, ANN202
    """The cost-to-go behind each piece of one conversation, and the conversation's counts."""
    rows = rows.sort_values("piece")
    m = np.array(rows["m"].tolist(), np.int64).reshape(-1, 4, 4)
    end, ends = ENDS.copy(), []
    for piece in m[::-1]:
        ends.append(end)
        end = np.minimum((piece + end[None, :]).min(axis=1), FAR)
    out = rows[["conv_id", "piece"]].assign(behind=[e.tolist() for e in ends[::-1]], last=[*[False] * (len(m) - 1), True])
    for c in ("blank", "duplicate", "truncated", "illegal"):
        out[c] = int(rows[c].sum())
    out["illegal"] += sum(a + b not in LEGAL for a, b in zip(rows["last"][:-1], rows["first"][1:], strict=True))
    known = rows[rows["turn_min"].notna()]
    low, high = [int(x) for x in known["turn_min"]], [int(x) for x in known["turn_max"]]
    distinct = int(known["turns"].sum()) - sum(a == b for a, b in zip(high[:-1], low[1:], strict=True))
    out["gaps"] = high[-1] - low[0] + 1 - distinct if low else 0
    out["cost"] = int(end[START])
    return out[["conv_id", "piece", "behind", "last", *COUNTS]]


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the state that its tracing ends in, from each state."""
    for rows in _gathered(batches, ["piece", "conv_id"]):
        lanes = Lanes(rows, ["piece", "conv_id"])
        at = lanes.row_edges[:-1]
        behind = np.array([rows.column("behind")[i].as_py() for i in at], np.int64).reshape(-1, 4)
        leads = np.zeros((len(lanes), 4), np.int64)
        for some, initial, fault, weight, _, length in lanes.buckets(CELLS // 4):
            go = costs_to_go(initial, fault, weight, length, behind[some][:, :, None])
            for s in range(4):
                leads[some, s] = trace(go, initial, fault, weight, length, np.full(len(some), s), np.zeros(len(some), bool))[2]
        yield pa.RecordBatch.from_arrays([pa.array(lanes.keys[1], rows.schema.field("conv_id").type), pa.array(lanes.keys[0], pa.int32()), pa.array(list(leads), pa.list_(pa.int64()))], names=["conv_id", "piece", "leads"])


def _starts(rows):  # noqa: ANN001, ANN202
    rows = rows.sort_values("piece")
    state, out = START, []
    for leads in rows["leads"]:
        out.append(state)
        state = int(leads[state])
    return rows[["conv_id", "piece"]].assign(start=np.array(out, np.int32))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _gathered(batches, ["piece", "conv_id"]):
        lanes = Lanes(rows, ["piece", "conv_id"])
        at = pa.array(lanes.row_edges[:-1], pa.int64())
        behind = np.array(rows.column("behind").take(at).to_pylist(), np.int64).reshape(-1, 4)
        _, audits, turns = lanes.traced(rows.column("start").take(at).to_numpy().astype(np.int64), behind, rows.column("last").take(at).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(lanes.keys[1], rows.schema.field("conv_id").type), *[rows.column(c).take(at).combine_chunks() for c in COUNTS], pa.array(audits, pa.string()), turns, pa.array(lanes.keys[0], pa.int32())], names=["conv_id", *COUNTS, "audit", "turns", "piece"])


def _in_pieces(rows: DataFrame, n: int, long_rows: int) -> DataFrame:
    """The repaired pieces of long conversations, whose rows are n."""
    kind = dict(rows.dtypes)["conv_id"]
    same = lambda a, b: a.eqNullSafe(b)
    digest = F.sha2("text", 256)
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", digest)
    firsts = rows.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(F.struct("turn"))["turn"].alias("turn")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("turn").alias("_t"))
    merged = merged.join(firsts, same(F.col("conv_id"), F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")) & same(F.col("turn"), F.col("_t")), "left")
    merged = merged.select(*_ORDER, "copies", F.col("_r").isNotNull().alias("first"))
    dealt = merged.repartitionByRange(max(1, -(-n // long_rows)), "conv_id", "turn", "role", F.substring("text", 1, 128)).sortWithinPartitions(*_ORDER)
    dealt = cut(dealt.withColumn("piece", F.spark_partition_id()))
    key = f"conv_id {kind}, piece int"

    def of_piece(small: DataFrame) -> DataFrame:
        small = small.withColumnsRenamed({"conv_id": "_c", "piece": "_p"})
        joined = dealt.join(sized_broadcast(small, 256 * small.count()), same(F.col("conv_id"), F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p")
        return joined.sortWithinPartitions("piece", *_ORDER)

    counted = dealt.mapInArrow(_matrices, f"{key}, {_MATRIX}")
    behind = cut(counted.groupBy("conv_id").applyInPandas(_behind, f"{key}, behind array<long>, last boolean, {', '.join(f'{c} long' for c in COUNTS)}"))
    starts = of_piece(behind).mapInArrow(_leads, f"{key}, leads array<long>").groupBy("conv_id").applyInPandas(_starts, f"{key}, start int")
    starts = starts.withColumnsRenamed({"conv_id": "_c", "piece": "_p"})
    ready = cut(behind.join(starts, same(F.col("conv_id"), F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p"))
    return of_piece(ready).mapInArrow(_pieces, _schema(kind, "piece int"))


def _schema(kind: str, *more: str) -> str:
    return ", ".join([f"conv_id {kind}", *[f"{c} long" for c in COUNTS], "audit string", f"turns {TURNS}", *more])


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with copies (1 where the input has none) and nulls as one space."""
    copies = F.coalesce(F.col("copies").cast("long"), F.lit(1)) if "copies" in conversations.columns else F.lit(1).cast("long")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"), copies.alias("copies"))


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """conv_id, counts, cost, audit, turns (role and text after the repair) and piece of each conversation.

    piece is NULL, but for conversations of more than `long_rows` rows or
    `long_bytes` bytes of text: they come as several rows whose audits and
    turns follow each other by piece, the counts repeated in each.  A column
    `copies`, where there is one, says how often a row stands there; a
    conversation of rows with 0 copies only has no rows and zero counts.
    """
    rows = _rows(conversations)
    kind = dict(rows.dtypes)["conv_id"]
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("copies") > 0, F.octet_length("text").cast("long"))).alias("bytes"))
    large = sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))
    found = large.agg(F.count("*"), F.sum("n"), F.sum("bytes")).first()
    short = rows
    if found[0]:
        ids = sized_broadcast(large.select(F.col("conv_id").alias("_c")), 64 * found[0])
        short = rows.join(ids, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    whole = short.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(_whole, _schema(kind)).withColumn("piece", F.lit(None).cast("int"))
    if not found[0]:
        return whole
    n = max(found[1], -(-found[2] * long_rows // long_bytes))
    long = rows.join(ids, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").filter("copies > 0")
    return whole.unionByName(_in_pieces(long, n, long_rows))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conv_id and piece: one row a conversation, its hash carried from piece to piece."""
    now, audit, digest, between = None, [], None, b""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*now[1], pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for b in batches:
        for i in range(b.num_rows):
            key = b.column("conv_id")[i].as_py()
            if now is None or now[0] != key:
                if now is not None:
                    yield done()
                now, audit, digest, between = (key, [b.column(c).slice(i, 1) for c in ("conv_id", *COUNTS)]), [], hashlib.sha256(), b""
            audit.append(b.column("audit")[i].as_py())
            for turn in b.column("turns")[i].as_py():
                digest.update(between + f"{turn['role']}:{turn['text']}".encode())
                between = b"\n"
    if now is not None:
        yield done()


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, counts, cost, audit and the SHA-256 of its repaired `role:text` lines."""
    lines: Column = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.filter("piece IS NULL").select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    kind = dict(repaired.dtypes)["conv_id"]
    pieces = repaired.filter("piece IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(pieces.mapInArrow(_hashed, ", ".join([f"conv_id {kind}", *[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string"])))
