import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barflow.llm import decontaminate, neardup, packing, substring, toxicity
from barflow.llm.text import shingle_set, shingles, sliced, words

settings.register_profile("busy", deadline=None)  # times depend on what else the machine does
settings.load_profile("busy")

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÉé. ", max_size=40)), max_size=6)


@given(TEXTS)
def test_words_are_runs_between_ascii_spaces(texts):
    w = words(pa.array(texts, pa.string()))
    assert len(w) == len(texts)
    for k, t in enumerate(texts):
        own = w.of(k)
        assert [bytes(w.data[a:b]) for a, b in zip(w.start[own], w.end[own])] == (t or "").encode().split()
    plain = [x for t in texts for x in (t or "").encode().split()]
    same = {x: h for x, h in zip(plain, w.hash.tolist())}
    assert [same[x] for x in plain] == w.hash.tolist() and len(set(same.values())) == len(same)


def test_batches_are_cut_by_bytes_and_slices_are_read_right():
    b = pa.RecordBatch.from_pydict({"text": ["aa bb", None, "cc", "dd ee ff"]})
    parts = list(sliced([b], limit=4))
    assert sum(p.num_rows for p in parts) == 4
    assert [len(words(p.column("text")).hash) for p in parts if p.num_rows == 1][-1] == 3


def test_shingle_sets():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(shingle_set(h, 5)) == 4 and len(shingle_set(h[:3], 5)) == 1 and len(shingle_set(h[:0], 5)) == 0
    assert shingles(h, 9).size == 0


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_minimizers_meet(docs):
    w = words(pa.array([" ".join(d) for d in docs]))
    at, place, g = substring.minimizers(w)
    flat = [x for d in docs for x in d]
    seen = {}
    for i, p in zip(at.tolist(), place.tolist()):
        window = tuple(flat[i : i + 20])
        assert 0 <= p - i <= 12
        assert seen.setdefault(window, p - i) == p - i


@given(st.lists(st.integers(1, 3000), min_size=1, max_size=30), st.randoms())
def test_packing_covers_every_token_once(lengths, rnd):
    ends = np.zeros(50257, bool)
    ends[13] = True
    docs = [(k, np.array([rnd.choice([13, 5, 7]) for _ in range(n)], np.uint32)) for k, n in enumerate(lengths)]
    rows, used = packing.pack_block(docs, 10, ends)
    at, size = {}, {}
    for doc, start, length, crc, total, seq, offset in rows:
        assert at.get(doc, 0) == start and total == lengths[doc] and size.get(seq, 0) == offset
        at[doc], size[seq] = start + length, offset + length
    assert at == dict(enumerate(lengths)) and max(size.values()) <= 2048 and set(size) == set(range(10, 10 + used))


def test_cuts_are_optimal_on_small_cases():
    rng = np.random.default_rng(3)

    def cost(n):
        return 0 if n & (n - 1) == 0 else 16 - n

    for _ in range(30):
        ends = np.unique(rng.integers(1, 60, 25))
        ends = ends[: 1 + int(np.argmax(np.concatenate([np.diff(np.concatenate([[0], ends])) > 16, [True]])))] if (np.diff(np.concatenate([[0], ends])) > 16).any() else ends
        if np.diff(np.concatenate([[0], ends])).max() > 16:
            continue
        pay = rng.integers(0, 5, len(ends)).astype(float)
        best = {0: 0.0}
        for p, c in zip(ends.tolist(), pay):
            best[p] = c + min(v + cost(p - q) for q, v in best.items() if p - q <= 16)
        cuts = packing.choose_cuts(ends, pay, 16)
        got = sum(cost(b - a) + pay[ends.tolist().index(b)] for a, b in zip([0, *cuts], cuts))
        assert got == best[ends[-1]]


def test_codec_equals_the_tokenizer():
    c = packing.codec()
    for t in ["Hello, world's  end \n\n x", "é ñ 123abc", "a<|endoftext|>b", "", "　\t\t!!"]:
        assert c.encode(t) == c.exact.encode(t, add_special_tokens=False).ids


def test_components_of_sets_by_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 34, replace=False), rng.integers(0, 2**60, int(rng.integers(0, 6))).astype(np.uint64)])) for _ in range(40)]
    label = list(range(40))
    for i in range(40):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert neardup.link_sets(sets).tolist() == label


def test_items_are_found_in_any_place():
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 10**6, n))
    items = [(k, say(int(rng.integers(6, 70)))) for k in range(40)] + [(90, "only three words"), (91, ""), (92, None)]
    ix = decontaminate.Index([(k, t) for k, t in items if t is not None])
    docs, want = [], set()
    for d in range(60):
        k, t = items[int(rng.integers(0, 41))]
        docs.append(f"{say(int(rng.integers(0, 300)))} {t} {say(int(rng.integers(0, 300)))}".strip())
        want.add((d, k))
    got = {(d, ix.ids[j]) for d, j, *_ in ix.matches(pa.array(docs), 0.75)}
    assert got == want and ix.matches(pa.array([None, "", "a"]), 0.75) == []


def test_parts_of_items_are_found():
    """Three quarters of an item in one run, and the whole item in two or four places far apart."""
    rng = np.random.default_rng(6)
    say = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    items = [say(int(rng.integers(30, 80))) for _ in range(150)]
    ix = decontaminate.Index([(k, " ".join(t)) for k, t in enumerate(items)])
    for pieces in (1, 2, 4):
        docs = []
        for t in items:
            if pieces == 1:
                need = int(np.ceil(0.76 * (len(t) - 4))) + 4
                docs.append([*say(200), *t[:need], *say(200)])
            else:
                # every cut loses four shingles, so only items that keep three quarters of theirs count
                edges = [len(t) * k // pieces for k in range(pieces + 1)]
                docs.append([x for a, b in zip(edges, edges[1:]) for x in (*t[a:b], *say(600))])
        want = {d for d, (t, w) in enumerate(zip(items, docs)) if len({tuple(t[k : k + 5]) for k in range(len(t) - 4)} & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) >= 0.75 * (len(t) - 4)}
        got = {d for d, j, *_ in ix.matches(pa.array([" ".join(w) for w in docs]), 0.75) if ix.ids[j] == d}
        assert got <= want and len(got) >= 0.99 * len(want) and len(want) >= (150 if pieces == 1 else 60 if pieces == 2 else 20), (pieces, len(got), len(want))


def test_isotonic_and_trees():
    at, rate = toxicity.isotonic(np.array([3.0, 1, 2, 2]), np.array([1.0, 0, 1, 0]), np.ones(4))
    assert at.tolist() == [1, 2, 3] and rate.tolist() == [0, 0.5, 1]
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    assert ((toxicity.Trees(x, y, rounds=40).raw(x) > 0) == (y == 1)).mean() > 0.95
    f = dict(zip(range(14), toxicity.features("You IDIOT! you id1ot", {})))
    assert f[0] > 0 and f[7] > 0 and f[8] > 0 and len(toxicity.features(None, {})) == toxicity.FEATURES
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
