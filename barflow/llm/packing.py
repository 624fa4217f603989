"""Order-preserving packing of token streams by dynamic programming.

Documents are tokenized and laid end to end in scan order.  Windows of at
most `window` tokens cover the stream; window cuts are chosen among all document
ends, sentence ends and forced positions (multiples of the window, and a window
after each other cut, which pads nothing) so that padding plus truncation
penalties are least.  With cost padding(j, i) = window - (j - i) the
transition separates, so the best predecessor within reach is the front of a
monotone queue; windows whose length is a power of two carry no padding and
are tried as further transitions.

The operator needs no shuffle: each task packs its own partition in blocks of
`BLOCK_TOKENS`, and a block's last, short window is cut into powers of two.
Defined results: a null or empty text is its end token alone; texts with very
long runs of blanks or of other characters are encoded by the exact tokenizer;
repeated rows are packed as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import sliced

WINDOW = 2048
END_ID = 1
#: Tokens that one dynamic program covers; bounds memory and the loss at its end.
BLOCK_TOKENS = 1 << 20
#: Cost, in padding tokens, of cutting at a sentence end and inside a sentence.
SENTENCE_COST, FORCED_COST = 4.0, 24.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters in a run of blanks, or of others, from which the fast tokenizer's pattern search is not trusted (it gives way near a million).
LONG_RUN = 100_000
_BLANKS = re.compile(r"\s+")


def has_long_run(text: str) -> bool:
    if len(text) < LONG_RUN:
        return False
    at = 0
    for m in _BLANKS.finditer(text):
        if m.start() - at >= LONG_RUN or m.end() - m.start() >= LONG_RUN:
            return True
        at = m.end()
    return len(text) - at >= LONG_RUN


_CODEC: dict[str, object] = {}


class Codec:
    """ids as tokenizers gives them for byte_bpe_50k; the same ranks in tiktoken are several times as fast."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sentence_end = np.zeros(max(len(ranks) + 1, self.exact.get_vocab_size()), bool)
        for token, k in ranks.items():
            t = token.rstrip(b" ")
            self.sentence_end[k] = t[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added) or has_long_run(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a panic of the fast tokenizer is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return self.exact.encode(text, add_special_tokens=False).ids


def codec() -> Codec:
    if "bpe" not in _CODEC:
        import public_tokenizers

        _CODEC["bpe"] = Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _CODEC["bpe"]


def choose_cuts(ends: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cut positions, ascending and ending at ends[-1], of least total padding plus cost.

    ends: candidate positions, ascending, no two more than `window` apart (nor the first from 0); costs: of a cut at each.
    """
    place = np.concatenate([[0], ends]).astype(np.int64)
    pos, pay = place.tolist(), [0.0, *costs.tolist()]
    # the cuts that lie a power of two before each
    known = np.full(place[-1] + 1, -1)
    known[place] = np.arange(len(place))
    before = place[:, None] - (1 << np.arange(window.bit_length()))
    before = np.where(before >= 0, known[np.maximum(before, 0)], -1)
    whole = before[before >= 0].tolist()
    edge = np.concatenate([[0], np.cumsum((before >= 0).sum(axis=1))]).tolist()
    best, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        value, i = queue[0]
        value += window - p
        for k in whole[edge[j] : edge[j + 1]]:
            if best[k] <= value:
                value, i = best[k], k
        best[j], back[j] = value + pay[j], i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and their costs for a block of tokens whose documents end at doc_ends."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    stop = np.flatnonzero(sentence_end[ids]) + 1
    cost[stop] = SENTENCE_COST
    cost[doc_ends] = 0.0
    cost[0] = np.inf
    cost[np.arange(window, n, window)] = np.minimum(cost[np.arange(window, n, window)], FORCED_COST)
    rest, p = n % window, n - n % window
    for b in range(window.bit_length(), -1, -1):  # the last window splits without padding
        if rest >> b & 1:
            p += 1 << b
            cost[p] = min(cost[p], FORCED_COST)
    cost[n] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    # a cut a whole window after a boundary pads nothing
    far = at[at < n - window] + window
    cost[far] = np.minimum(cost[far], FORCED_COST)
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def pack_block(docs: list[tuple[int | None, np.ndarray]], first_sequence: int, sentence_end: np.ndarray, window: int = WINDOW) -> tuple[list[tuple], int]:
    """Pieces (doc_id, start, length, crc32, doc_tokens, sequence_id, offset) of documents laid end to end, and the number of sequences."""
    ids = np.concatenate([d for _, d in docs])
    ends = np.cumsum([len(d) for _, d in docs])
    cuts = choose_cuts(*candidates(ids, ends, sentence_end, window), window)
    marks = np.unique(np.concatenate([ends, cuts]))
    starts = np.concatenate([[0], marks[:-1]])
    doc = np.searchsorted(ends, starts, side="right")
    seq = np.searchsorted(cuts, starts, side="right")
    doc_start = np.concatenate([[0], ends[:-1]])
    seq_start = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
    raw = ids.astype("<u4").tobytes()
    out = []
    for s, e, d, q in zip(starts.tolist(), marks.tolist(), doc.tolist(), seq.tolist(), strict=True):
        out.append((docs[d][0], s - int(doc_start[d]), e - s, zlib.crc32(raw[4 * s : 4 * e]), len(docs[d][1]), first_sequence + q, s - int(seq_start[q])))
    return out, len(cuts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe, held, tokens = codec(), [], 0
    sequence = TaskContext.get().partitionId() << 40
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def flush() -> pa.RecordBatch:
        nonlocal sequence, held, tokens
        rows, used = pack_block(held, sequence, bpe.sentence_end)
        sequence, held, tokens = sequence + used, [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    for b in sliced(batches):
        for k, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.array([*bpe.encode(text or ""), END_ID], np.uint32)
            held.append((k, ids))
            tokens += len(ids)
            if tokens >= BLOCK_TOKENS:
                yield flush()
    if held:
        yield flush()


def pack(documents: DataFrame) -> DataFrame:
    """One row per piece of a document; see SCHEMA."""
    return documents.select("doc_id", "text").mapInArrow(_pack, SCHEMA)
