"""Queries agree with SQL on small tables, and each pipeline stage keeps what it should."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from barflow.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(spark, tables, name):
    df, want = q.queries()[name](spark, SF), tables.sql(q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, ([r[c] for c in columns] for r in df.collect()))) == sorted(map(repr, ([r[want.columns.index(c)] for c in columns] for r in want.fetchall())))


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        docs = p.cut(out)
        assert 0 < docs.count() <= n
        n = docs.count()
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = docs.filter("false")
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def shingles(text, n=5):
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents that hold copies, near copies, repeated passages, benchmark items and toxic texts, and odd rows with further columns."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    say = lambda n: [word() for _ in range(n)]
    items, passage = [(k, " ".join(say(30))) for k in range(4)], say(60)
    texts = [say(int(rng.integers(30, 90))) for _ in range(60)]
    for k in range(6):
        texts += [texts[k], [*texts[k][:-1], "end"], [*texts[20 + k], *passage, *say(5)], [*texts[30 + k], *items[k % 4][1].split(), *say(9)], ["you", "stupid", "idiot", *texts[40 + k][:25], "worthless", "moron"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \n\t "), (503, "short"), (503, "short"), (504, "long " * 40_000), (None, "no id here at all in this text"), (None, "no id here at all in this text")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, "x", 2) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, _key string, component int")
    marked = [(k, 1, int(t[:2] == ["you", "stupid"])) for k, t in enumerate(texts) if k % 4]
    d = str(tmp_path_factory.mktemp("small"))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.read.parquet(f"{d}/documents.parquet").persist(), d, dict(items)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxicity_stage_by_brute_force(spark, small):
    import corpus_pipeline as p

    docs, d, _ = small
    model = p.toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), p.F.lit(True))
    want = sorted(((k, t) for k, t in pairs(docs) if model.score([t])[0] < p.toxicity.THRESHOLD or not (t or "").strip()), key=str)
    out = p.drop_toxic(spark, docs, d)
    assert out.columns == docs.columns and pairs(out) == want
    lost = {k for k, _ in pairs(docs)} - {k for k, _ in want}
    toxic = {k for k, t in pairs(docs) if (t or "").startswith("you stupid")}
    # of some 60 labels, six of them toxic, a model learns little about odd rows; accuracy on many labels is tested beside the operator
    assert toxic and toxic <= lost and len(lost - toxic - {503, 504, None}) <= 2


def test_near_duplicate_stage_by_brute_force(spark, small):
    import corpus_pipeline as p

    docs, d, _ = small
    rows = pairs(docs)
    sets = [shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(3):
        label = [min(label[j] for j, y in enumerate(sets) if j == i or x and 100 * len(x & y) >= 75 * len(x | y)) for i, x in enumerate(sets)]
    groups, want = {}, []
    for (k, t), c, x in zip(rows, label, sets):
        if x:
            groups.setdefault(c, []).append((k is None, k or 0, t))
        else:
            want.append((k, t))
    want += [(None if least[0] else least[1], least[2]) for least in map(min, groups.values())]
    out = p.drop_near_duplicates(spark, docs, d)
    assert out.columns == docs.columns and pairs(out) == sorted(want, key=str) and len(want) < len(rows) - 10


def test_repeated_run_stage_by_brute_force(spark, small):
    import corpus_pipeline as p

    docs, d, _ = small
    docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    seen, want = set(), []
    for k, t in sorted(pairs(docs), key=lambda r: r[0]):
        w, gone = (t or "").split(), set()
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if run in seen else set()
            seen.add(run)
        want.append((k, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    out = p.drop_repeated_runs(spark, docs, d)
    assert out.columns == docs.columns and pairs(out) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in out.filter("text IS NOT NULL").collect())


def test_leak_stage_by_brute_force(spark, small):
    import corpus_pipeline as p

    docs, d, items = small
    item = [shingles(t) for t in items.values()]
    want = [(k, t) for k, t in pairs(docs) if not any(len(x & shingles(t or "")) >= 0.75 * len(x) for x in item)]
    out = p.drop_leaks(spark, docs, d)
    assert out.columns == docs.columns and pairs(out) == want and len(want) == len(pairs(docs)) - 6


def test_packing_stage_round_trip(spark, small):
    import corpus_pipeline as p

    docs, d, _ = small
    docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    own = {r.doc_id: [*p.packing.codec().exact.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces = {}
    for r in p.pack(spark, docs, d).orderBy("doc_id", "start").collect():
        assert r.start == pieces.get(r.doc_id, 0) and r.ids_crc32 == zlib.crc32(np.array(own[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id] = r.start + r.length
    assert pieces == {k: len(v) for k, v in own.items()}


def test_whole_pipeline_is_its_stages(spark, small):
    import corpus_pipeline as p

    docs, d, _ = small
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, d)
    ids = {r.doc_id for r in docs.collect()}
    got = {r.doc_id for r in p.run(spark, d).collect()}
    assert got == ids and {500, 501, 502} <= got


def test_queries_run(spark):
    for name in ("op2_toxicity", "op4_quality", "op7_langid", "op8_packing", "op10_licenses"):
        assert q.queries()[name](spark, SF).count() >= 200
