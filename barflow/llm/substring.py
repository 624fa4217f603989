"""Removal of repeated word runs by prefix-partitioned sparse suffix trees.

A suffix is a document's words from one position on.  Of each 20-word window
one suffix is kept, the one at its minimizer (the least-hashed 8-word run that
begins among the window's first 13 words): equal windows keep it at the same
place, so each repeat of 20 words or more runs through a shared suffix.  A
suffix carries the words that its windows reach, up to 12 to the left and 20
from its place on.

1. Prefixes are counted, beginning with 8 words.  A prefix that occurs once
   leads to a leaf, so its suffixes are never written out.
2. Suffixes are split by prefix into groups of FOREST rows at most, each with
   as many whole prefixes as fit.  A group's subtrees are built in memory as a
   suffix array with the lengths of common prefixes; an internal node of depth
   20 - o, cut by the o words to the left, holds the occurrences of one window.
   Its first leaf stays, the windows of the others go, and overlapping windows
   join to maximal repeats.
3. A prefix of more than HOT suffixes is lengthened.  Of its suffixes with the
   same words all but the first are settled at once, found by partial
   aggregation and joined with hot ones dealt over many tasks; the others are
   cut into two halves of their windows, which share more words (8, then 14 or
   15, up to the 20 of a single window), until their prefixes fit a group.  So no
   passage, however frequent, is gathered in one task.

Documents whose whole word sequence an earlier one has are settled before by a
128-bit digest: all their windows start earlier, and the first copy stands for
them in every tree.  Words of subtrees are compared themselves, those of
equal suffixes of lengthened prefixes by 128-bit digests.

Defined results: null texts have no words; texts under 20 words lose none;
the first occurrence is by doc_id, then position; rows sharing a doc_id are
taken as one document and lose what any of them loses; a row without doc_id
neither loses nor takes away words; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, sized_broadcast, spread_join
from .text import Words, mix, shingles, sliced, words

WINDOW, SAMPLED = 20, 8
_REACH = WINDOW - SAMPLED + 1
#: Suffixes of a prefix beyond which it is lengthened, and suffixes whose subtrees are built at once.
HOT, FOREST = 4096, 1 << 16


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over each n consecutive entries, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


_PLACE = np.uint64(30)


def minimizers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a batch, the start of each one's minimizer, and the hashes of all 8-word runs."""
    if len(w.hash) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = shingles(w.hash, SAMPLED)
    # the hash's high bits, then the place: equal ones give the leftmost, in every occurrence alike
    keyed = (g >> _PLACE << _PLACE) | np.arange(len(g), dtype=np.uint64)
    low = _sliding(keyed, _REACH, np.minimum) & ((np.uint64(1) << _PLACE) - np.uint64(1))
    end = np.repeat(w.offsets[1:], np.diff(w.offsets))
    at = np.flatnonzero(np.arange(len(low)) + WINDOW <= end[: len(low)])
    return at, low[at].astype(np.int64), g


def _owners(w: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.offsets, at, side="right") - 1


def _edges(change: np.ndarray) -> np.ndarray:
    """Where runs begin, given between which neighbours there is a change."""
    return np.flatnonzero(np.concatenate([[True], change]))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


_SEEDS = (np.uint64(0x51ED270B), np.uint64(0x7F4A7C15F39CC060))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: number of words, digest of all, and hash and place of the 8-word prefix of each kept suffix."""
    for b in sliced(batches):
        w = words(b.column("text"))
        n = np.diff(w.offsets)
        within = np.arange(len(w.hash)) - np.repeat(w.offsets[:-1], n)
        sums = []
        for salt in _SEEDS:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash ^ mix(within.astype(np.uint64) + salt)))])
            sums.append(pa.array((total[w.offsets[1:]] - total[w.offsets[:-1]]).view(np.int64)))
        _, place, g = minimizers(w)
        place = place[_edges(place[1:] != place[:-1])] if len(place) else place
        d = _owners(w, place)
        each = np.bincount(d, minlength=len(w)) if len(d) else np.zeros(len(w), np.int64)
        columns = [b.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), *sums, _lists(g[place].view(np.int64), each), _lists((place - w.offsets[d]).astype(np.int32), each)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "d1", "d2", "h", "pos"])


def _spaced(w: Words) -> tuple[bytes, np.ndarray]:
    """All words of a batch, each with one space behind, and where each begins there."""
    size = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(begin[-1], 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[within + np.repeat(begin[:-1], size)] = w.data[within + np.repeat(w.start, size)]
    return out.tobytes(), begin


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept suffixes of repeated prefixes with their words, and whether the prefix is hot."""
    for b in sliced(batches, limit=1 << 20):
        w = words(b.column("text"))
        at, place, g = minimizers(w)
        marks = b.column("at")
        lists = np.diff(marks.offsets.to_numpy())
        coded = marks.flatten().to_numpy(zero_copy_only=False)
        known, flag = (coded >> 1) + np.repeat(w.offsets[:-1], lists), coded & 1 == 1
        inside = known < np.repeat(w.offsets[1:], lists)
        near, hot = np.zeros(len(w.hash), bool), np.zeros(len(w.hash), bool)
        near[known[inside]], hot[known[inside & flag]] = True, True
        on = near[place]
        at, place = at[on], place[on]
        if not len(at):
            continue
        first = _edges((place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))
        windows = np.diff(np.append(first, len(at)))
        begin = at[first]
        raw, byte = _spaced(w)
        text = [raw[x:y] for x, y in zip(byte[begin].tolist(), byte[begin + windows + WINDOW - 1].tolist(), strict=True)]
        d = _owners(w, begin)
        yield _rows(g[place[first]].view(np.int64), b.column("doc_id").cast(pa.int64()).take(pa.array(d)), begin - w.offsets[d], place[first] - begin, windows, text, hot=hot[place[first]])


def _rows(h: np.ndarray, doc_id: pa.Array, start: np.ndarray, lead: np.ndarray, windows: np.ndarray, text: list[bytes], **more: np.ndarray) -> pa.RecordBatch:
    small = {"start": start, "lead": lead, "windows": windows}
    columns = {"h": pa.array(h), "doc_id": doc_id, **{k: pa.array(v.astype(np.int32)) for k, v in small.items()}, "text": pa.array(text, pa.binary()), **{k: pa.array(v) for k, v in more.items()}}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_SUFFIX = "h long, doc_id long, start int, lead int, windows int, text binary"
_PART = f"{_SUFFIX}, lo int, hi int, c1 long, c2 long, more array<int>"


def _parts(halve: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes, whole or cut into two by their windows, with their prefix (h) and two digests of all words.

    A suffix has windows that begin lo to hi words before its place, so all have
    lo words to the left and 20 - hi from the place on in common: the prefix.
    Whole suffixes of one document with the same words are one row, the first,
    with the starts of the others in `more`.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "lead", "windows", "lo", "hi")}
            texts = b.column("text").to_pylist()
            w = words(b.column("text").cast(pa.large_string()))
            mid = (c["lo"] + c["hi"] + 1) // 2
            for lo, hi in ((c["lo"], mid - 1), (mid, c["hi"])) if halve else ((c["lo"], c["hi"]),):
                most, least = np.minimum(c["lead"], hi), np.maximum(c["lead"] - c["windows"] + 1, lo)
                on = np.flatnonzero(most >= least)
                if not len(on):
                    continue
                lo, hi, most, least = lo[on], hi[on], most[on], least[on]
                skip, size = c["lead"][on] - most, most - least + WINDOW
                first = w.offsets[on] + skip
                begin, end = w.start[first] - w.start[w.offsets[on]], w.end[first + size - 1] + 1 - w.start[w.offsets[on]]
                text = [texts[k][x:y] for k, x, y in zip(on.tolist(), begin.tolist(), end.tolist(), strict=True)]
                edge = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(edge[-1]) - np.repeat(edge[:-1] + most, size)  # of each word, counted from the suffix's
                own = w.hash[np.repeat(first, size) + np.arange(edge[-1]) - np.repeat(edge[:-1], size)]
                terms = [mix(own ^ mix((place + WINDOW).astype(np.uint64) + s)) for s in _SEEDS]
                shared = (place >= -np.repeat(lo, size)) & (place < WINDOW - np.repeat(hi, size))
                sums = [np.add.reduceat(x, edge[:-1]).view(np.int64) for x in (np.where(shared, terms[0], np.uint64(0)), *terms)]
                start, keep, more = c["start"][on] + skip, np.arange(len(on)), [[]] * len(on)
                if not halve:
                    keep, more = _first_of(b.column("doc_id"), start, sums[1], sums[2])
                doc = b.column("doc_id").take(pa.array(on[keep]))
                row = _rows(sums[0][keep], doc, start[keep], most[keep], (most - least + 1)[keep], [text[k] for k in keep.tolist()], lo=lo[keep].astype(np.int32), hi=hi[keep].astype(np.int32), c1=sums[1][keep], c2=sums[2][keep])
                yield row.append_column("more", pa.array(more, pa.list_(pa.int32())))

    return rows


def _first_of(doc_id: pa.Array, start: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The first row of each document and digest, and the starts of the others beside it."""
    doc = doc_id.to_numpy(zero_copy_only=False)
    order = np.lexsort((start, c2, c1, doc))
    edge = _edges((doc[order][1:] != doc[order][:-1]) | (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1]))
    ends = np.append(edge[1:], len(order))
    return order[edge], [start[order[x + 1 : y]].tolist() for x, y in zip(edge.tolist(), ends.tolist(), strict=True)]


def repeated_in_forest(doc: np.ndarray, start: np.ndarray, lead: np.ndarray, windows: np.ndarray, text: pa.Array) -> np.ndarray:
    """For each suffix a mask of its windows (bit i: the one at start + i) that stand at an earlier place too.

    lead: words to the left of the suffix's place; text: its words, each with a
    space behind.  Rows of many prefixes form one forest; their order is free.
    """
    m = len(doc)
    text = text.cast(pa.large_binary())
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + m + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]
    ends = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1]).astype(np.int64)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    code = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)  # the words themselves, as numbers
    size = windows.astype(np.int64) + WINDOW - 1
    place = np.cumsum(size) - size + lead

    at = start.astype(np.int64) + lead
    order = np.lexsort((at, doc))  # rows by place in the corpus, so the first of any rows is the least
    doc, at, place, lead, windows = doc[order], at[order], place[order], lead[order].astype(np.int64), windows[order].astype(np.int64)
    reach = windows + WINDOW - 1 - lead
    right = np.where(np.arange(WINDOW) < reach[:, None], code[np.minimum(place[:, None] + np.arange(WINDOW), len(code) - 1)], -1)
    pairs = (right[:, 0::2] + 1 << 32) | (right[:, 1::2] + 1)
    array = np.lexsort(pairs.T[::-1])  # the suffix array, and the length of the prefix that neighbours in it share
    common = np.logical_and.accumulate(right[array[1:]] == right[array[:-1]], axis=1).sum(axis=1)
    common = np.minimum(common, np.minimum(reach[array[1:]], reach[array[:-1]]))

    mask, left, active, node = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m), np.zeros(m, np.int64)
    for o in range(_REACH):
        if o:
            active = active[lead[active] >= o]
            if not len(active):
                break
            left[active] = np.unique(left[active] * (len(code) + 1) + code[place[active] - o], return_inverse=True)[1]
        node[array] = np.cumsum(np.concatenate([[0], common < WINDOW - o]))  # internal nodes of depth WINDOW - o, leaves alone
        own = active[lead[active] - windows[active] < o]
        _, first, of = np.unique(node[own] * m + left[own], return_index=True, return_inverse=True)
        first = own[first[of]]
        later = (doc[first] != doc[own]) | (at[first] != at[own])
        mask[own[later]] |= 1 << (lead[own[later]] - o)
    out = np.zeros(m, np.int64)
    out[order] = mask
    return out


_JUDGED = "doc_id long, start int, mask int, lead int, windows int, text binary"


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of suffixes that come sorted by prefix, a forest of whole prefixes at a time; hot ones pass with their words, without a mask."""
    held: list[pa.RecordBatch] = []

    def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hot = t.column("hot").to_numpy(zero_copy_only=False).astype(bool)
        cold = t.filter(pa.array(~hot))
        if cold.num_rows:
            c = {k: cold.column(k).to_numpy() for k in ("doc_id", "start", "lead", "windows")}
            mask = repeated_in_forest(c["doc_id"], c["start"], c["lead"], c["windows"], cold.column("text").combine_chunks())
            on = mask > 0
            none = [pa.nulls(int(on.sum()), x) for x in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"][on]), pa.array(c["start"][on]), pa.array(mask[on].astype(np.int32)), *none], names=["doc_id", "start", "mask", "lead", "windows", "text"])
        if hot.any():
            rest = t.filter(pa.array(hot)).select(["doc_id", "start", "lead", "windows", "text"])
            yield from rest.add_column(2, "mask", pa.nulls(rest.num_rows, pa.int32())).to_batches()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < FOREST:
            continue
        t = pa.Table.from_batches(held)
        h = t.column("h").to_numpy()
        edge = int(np.searchsorted(h, h[-1]))  # the last prefix may go on in the next batch
        if edge:
            yield from judged(t.slice(0, edge))
        held = t.slice(edge).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield from judged(t)


def _judge(suffixes: DataFrame) -> DataFrame:
    """Suffixes (with hot) through forests; those of hot prefixes, which go by their document, are dealt over all tasks."""
    by = suffixes.withColumn("h", F.when(F.col("hot"), F.xxhash64("doc_id")).otherwise(F.col("h")))
    return by.repartition("h").sortWithinPartitions("h").mapInArrow(_forests, _JUDGED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        begin, end = [], []
        column = b.column("at")
        edges, inner = column.offsets.to_numpy(), column.values
        all_starts, all_masks = inner.field("start").to_numpy(zero_copy_only=False), inner.field("mask").to_numpy(zero_copy_only=False)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            on = (all_masks[x:y, None] >> np.arange(_REACH)) & 1 == 1
            s = np.unique((all_starts[x:y, None] + np.arange(_REACH))[on]).astype(np.int64)
            first = _edges(s[1:] > s[:-1] + WINDOW)
            begin.append(s[first].tolist())
            end.append((s[np.append(first[1:] - 1, len(s) - 1)] + WINDOW).tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(begin, kind), pa.array(end, kind)], names=["doc_id", "begin", "end"])


def _lengthened(hot: DataFrame) -> DataFrame:
    """doc_id and at (start, mask) of suffixes of hot prefixes (doc_id, start, lead, windows, text) that have windows which stand earlier too."""
    rows = hot.withColumns({"lo": F.lit(0), "hi": F.lit(_REACH - 1)}).mapInArrow(_parts(False), _PART)
    all_windows = F.expr("(1 << windows) - 1").alias("mask")
    settled, groups = [], []
    for k in range(_REACH.bit_length() + 1):  # until each part is a single window
        rows = cut(rows.mapInArrow(_parts(True), _PART) if k else rows)
        if not k:
            settled.append(rows.filter(F.size("more") > 0).select("doc_id", F.transform("more", lambda s: F.struct(s.alias("start"), all_windows)).alias("at")))
        first = F.min(F.struct("doc_id", "start", "h", "lead", "windows", "lo", "hi", "text")).alias("x")
        distinct = cut(rows.groupBy("c1", "c2").agg(first, F.count("*").alias("n")))
        same = distinct.filter("n > 1").select("c1", "c2", "n", F.col("x.doc_id").alias("first"), F.col("x.start").alias("place"))
        met = spread_join(rows.select("c1", "c2", "doc_id", "start", "windows"), same, ["c1", "c2"], "doc_id", HOT).filter("doc_id != first OR start != place")
        settled.append(met.select("doc_id", F.array(F.struct("start", all_windows)).alias("at")))
        left = distinct.select("x.*")
        hot = cut(left.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("h"))
        count = hot.count()
        few = sized_broadcast(hot, 16 * count)  # at most one in HOT rows
        groups.append(left.join(few, "h", "left_anti").select(*(x.split()[0] for x in _SUFFIX.split(", ")), F.lit(False).alias("hot")))
        if not count:
            break
        rows = left.join(few, "h", "left_semi")
    found = _judge(reduce(DataFrame.unionByName, groups)).select("doc_id", F.array(F.struct("start", "mask")).alias("at"))
    return reduce(DataFrame.unionByName, settled, found)


def repeated_runs(documents: DataFrame) -> DataFrame:
    """doc_id, begin, end: the word runs of each document that windows which also start earlier cover; checkpointed."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    prints = cut(docs.mapInArrow(_prefixes, "doc_id long, n_words long, d1 long, d2 long, h array<long>, pos array<int>").filter(F.col("n_words") >= WINDOW))
    first = cut(prints.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first != last").select("d1", "d2", "first", "n"))
    copies = cut(spread_join(prints.select("doc_id", "n_words", "d1", "d2"), first, ["d1", "d2"], "doc_id", HOT).filter("doc_id != first").groupBy("doc_id").agg(F.max("n_words").alias("n_words")))
    some = sized_broadcast(copies.select("doc_id"), 32 * copies.count())

    prefixes = prints.join(some, "doc_id", "left_anti").select("doc_id", "pos", F.posexplode("h").alias("i", "h")).select("h", "doc_id", F.col("pos")[F.col("i")].alias("pos"))
    repeated = cut(prefixes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    mark = F.col("pos") * 2 + (F.col("n") > HOT).cast("int")
    near = cut(spread_join(prefixes, repeated, ["h"], "doc_id", HOT).groupBy("doc_id").agg(F.collect_list(mark).alias("at")))
    size = near.agg(64 * F.count("*") + F.coalesce(F.sum(F.size("at")), F.lit(0)) * 4).first()[0]
    found = _judge(docs.join(sized_broadcast(near, size), "doc_id").mapInArrow(_suffixes, f"{_SUFFIX}, hot boolean"))
    some_hot = repeated.filter(F.col("n") > HOT).limit(1).count() > 0
    found = cut(found) if some_hot else found
    at = found.filter("mask IS NOT NULL").select("doc_id", F.array(F.struct("start", "mask")).alias("at"))
    if some_hot:
        at = at.unionByName(_lengthened(found.filter("mask IS NULL").drop("mask")))
    starts = at.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at"))
    whole = copies.select("doc_id", F.array(F.lit(0).cast("long")).alias("begin"), F.array("n_words").alias("end"))
    return cut(starts.join(some, "doc_id", "left_anti").mapInArrow(_runs, "doc_id long, begin array<long>, end array<long>").unionByName(whole))


def removed_words(n_words: int, begin: list[int], end: list[int]) -> np.ndarray:
    """Mask of the words in the runs."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, np.minimum(begin, n_words), 1)
    np.add.at(edge, np.minimum(end, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut_text(raw: bytes, begin: list[int] | None, end: list[int] | None) -> tuple[list[bytes], int]:
    """Kept words and how many were removed."""
    w = raw.split()
    if not begin:
        return w, 0
    gone = removed_words(len(w), begin, end)
    return [x for x, g in zip(w, gone.tolist(), strict=True) if not g], int(gone.sum())


def _with_runs(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with the lists of their runs' begins and ends, and those columns' names."""
    key, begin, end = fresh(documents, "key", "begin", "end")
    runs = repeated_runs(documents).select(F.col("doc_id").alias(key), F.col("begin").alias(begin), F.col("end").alias(end))
    size = runs.agg(80 * F.count("*") + F.coalesce(F.sum(F.size(begin)), F.lit(0)) * 16).first()[0]
    return documents.join(sized_broadcast(runs, size), documents["doc_id"].cast("long") == F.col(key), "left").drop(key), begin, end


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for text, x, y in zip(*(b.column(c).to_pylist() for c in ("text", begin, end)), strict=True):
                kept, gone = _cut_text((text or "").encode(), x, y)
                out.append((len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    met, begin, end = _with_runs(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return met.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(documents: DataFrame) -> DataFrame:
    """The documents, all columns, without their repeated words; a text that loses none stays as it is."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for text, x, y in zip(*(b.column(c).to_pylist() for c in ("text", begin, end)), strict=True):
                if text is not None and x:
                    kept, gone = _cut_text(text.encode(), x, y)
                    text = b" ".join(kept).decode() if gone else text
                out.append(text)
            k = b.schema.get_field_index("text")
            yield b.set_column(k, "text", pa.array(out, b.schema.field(k).type)).drop_columns([begin, end])

    met, begin, end = _with_runs(documents)
    return met.mapInArrow(rows, documents.schema)


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, in words, of the maximal repeats that removal takes; a whole copy is one as long as its document."""
    return repeated_runs(documents).select("doc_id", F.explode(F.arrays_zip("begin", "end")).alias("x")).select("doc_id", F.col("x.begin").alias("start"), (F.col("x.end") - F.col("x.begin")).alias("length"))
