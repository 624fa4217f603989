"""Near-duplicate components over MinHash bands, exact on the links it finds.

1. Every text becomes its set of distinct five-word shingles, 72 universal hash
   minima of it in 24 bands, a signature of one byte a minimum, and a 128-bit
   digest of the set.
2. Equal sets are one class; its smallest doc_id represents it.  Copies go no
   further, so thousands of them cost one row each.
3. In each band bucket signatures are compared, every member with every other in
   memory; those that agree in AGREE minima or more form groups, and only a
   group's members with its first go on as links (a star, never all pairs).
   A pair of similarity 0.75 agrees in fewer with probability of about 1e-6.
4. A bucket of more than BUCKET members is never gathered.  If most of its
   members agree with one of them, all are linked to that one.  Otherwise they
   are dealt to the buckets of each two bands they share (a pair of similarity
   0.75 shares two bands or more but for 4 in 100,000), and these are treated
   alike, the last resort being the link to one member.  So no link is lost
   here either, and texts that share a frequent passage but no more do not run
   together.
5. Components of these links, by alternating large-star and small-star, are
   clusters, verified on full sets in blocks of bounded size.  A cluster of one
   block is settled in one task.  A larger one first meets its hub block
   (linear), then only members that are not yet in its main component meet the
   others, so every link between two components of a cluster is found.
6. Verified links, as stars of their blocks, give the components.

A pair of similarity 0.75 shares no band with probability below 3 in a
million.  Defined results: null, empty and blank texts have no shingles and are
linked with nothing; a text under five words is one shingle; equal sets are
always linked; rows sharing a doc_id are one node, linked by any of their
texts; a row without doc_id is compared as any other, its component_id is the
smallest doc_id reached (null, and kept, if it reaches none); doc_ids are
below 2^62.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, sized_broadcast, spread_join
from .components import connected_components
from .text import mix, shingle_set, shingles, sliced, words

N = 5
BANDS, ROWS = 24, 3
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_500_000
#: Minima that must agree; members whose signatures are compared in memory at most; rows of whole buckets taken at once.
AGREE, BUCKET, BATCH = BANDS * ROWS // 2, 512, 1 << 14
#: Rows without doc_id are numbered from here on.
NAMELESS = 1 << 62

_RNG = np.random.default_rng(9)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    w = words(texts, lower=True)
    return [shingle_set(w.hash[w.of(k)], N) for k in range(len(w))]


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and the signature, a byte a minimum, of each non-empty set."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys, signature = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), BANDS * ROWS), np.uint8)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), first)
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] ^ (low + np.uint64((k + 1) << 34)))
        signature[:, k] = low.astype(np.uint8)
    return keys, signature


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = sets_of(b.column("text"))
        h1, h2 = digests(sets)
        full = [s for s in sets if len(s)]
        keys, signature = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), BANDS * ROWS), np.uint8)
        if full:
            own = [k for k, s in enumerate(sets) if len(s)]
            found = band_keys(full)
            keys[own], signature[own] = found[0].view(np.int64), found[1]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), bands, pa.array([x.tobytes() for x in signature], pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"])


def agreeing(bucket: np.ndarray, sig: np.ndarray, least: int = AGREE) -> np.ndarray:
    """For each row, sorted by bucket, the position of the first row of its group: rows of a bucket whose signatures agree, directly or through others."""
    m = len(bucket)
    label = np.arange(m)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(edge, m))
    after = np.repeat(edge + size, size) - label  # rows of the bucket from this one on
    one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(after > 1)
    for step in range(1, int(size.max(initial=1))):
        at = at[after[at] > step]
        same = at[np.count_nonzero(sig[at] == sig[at + step], axis=1) >= least]
        one.append(same)
        other.append(same + step)
    a, b = np.concatenate(one), np.concatenate(other)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group with its first row, from rows that come sorted by bucket, whole buckets at a time."""
    held: list[pa.RecordBatch] = []

    def linked(t: pa.Table) -> pa.RecordBatch:
        label = agreeing(t.column("bucket").to_numpy(), _signatures(t.column("sig").combine_chunks()))
        rep = t.column("rep").to_numpy()
        on = rep != rep[label]
        return pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[label][on])], names=["src", "dst"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < BATCH:
            continue
        t = pa.Table.from_batches(held)
        bucket = t.column("bucket").to_numpy()
        edge = int(np.searchsorted(bucket, bucket[-1]))
        if edge:
            yield linked(t.slice(0, edge))
        held = t.slice(edge).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield linked(t)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            both = np.count_nonzero(_signatures(b.column("sig")) == _signatures(b.column("hub_sig")), axis=1)
            yield b.drop_columns(["sig", "hub_sig"]).append_column("agrees", pa.array(both >= AGREE))


def _in_buckets(rows: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links in buckets (bucket, rep), and the rows of large buckets with their hub and whether they agree with it.

    signatures: rep, sig; checkpointed.
    """
    shared = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    met = cut(spread_join(rows, shared, ["bucket"], "rep").join(signatures, "rep").select("bucket", "rep", "n", "sig"))
    links = met.filter(F.col("n") <= BUCKET).select("bucket", "rep", "sig").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "src long, dst long")
    if not shared.filter(F.col("n") > BUCKET).limit(1).count():
        return links, None
    large = met.filter(F.col("n") > BUCKET)
    hubs = cut(large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep").alias("k"), F.col("rep").alias("hub"), F.col("sig").alias("hub_sig"))).alias("x"), F.count("*").alias("n")).select("bucket", "x.hub", "x.hub_sig", "n"))
    beside = spread_join(large.drop("n"), hubs, ["bucket"], "rep").select("bucket", "rep", "hub", "sig", "hub_sig")
    return links, cut(beside.mapInArrow(_agreement, "bucket long, rep long, hub long, agrees boolean"))


def candidate_links(classes: DataFrame) -> DataFrame:
    """src, dst: stars that no true link leaves the components of.  classes: rep, bands, sig; checkpointed."""
    signatures = classes.select("rep", "sig")
    links, large = _in_buckets(classes.select("rep", F.explode("bands").alias("bucket")), signatures)
    if large is None:
        return links
    star = F.col("rep") != F.col("hub")
    shares = large.groupBy("bucket").agg((F.avg(F.col("agrees").cast("int")) >= 0.5).alias("tight"))
    shares = cut(shares)
    few = sized_broadcast(shares, 32 * shares.count())  # at most one in BUCKET rows
    known = cut(large.join(few, "bucket"))
    links = links.unionByName(known.filter(star & F.col("tight")).select(F.col("rep").alias("src"), F.col("hub").alias("dst")))
    loose = known.filter("NOT tight").select("bucket", "rep")
    # two bands of a member make a bucket of their own
    other = loose.join(classes.select("rep", "bands"), "rep").select("rep", "bucket", F.explode("bands").alias("other")).filter("bucket != other")
    pairs = other.select("rep", F.xxhash64(F.least("bucket", "other"), F.greatest("bucket", "other")).alias("bucket")).distinct()
    more, large = _in_buckets(cut(pairs), signatures)
    links = links.unionByName(more)
    return links if large is None else links.unionByName(large.filter(star).select(F.col("rep").alias("src"), F.col("hub").alias("dst")))


def link_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the position of the first set of its component; sets are linked by exact intersections."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(m)
    if m == 1:
        return label
    flat = np.concatenate(sets)
    owner = np.repeat(label, size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    inter = np.zeros((m, m), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        x, y = np.searchsorted(number, [first, first + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[x:y], number[x:y] - first] = 1
        inter += part @ part.T
    both = inter.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    while True:
        low = np.where(linked, label[None, :], m).min(axis=1)
        low = np.minimum(label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _link(key: tuple, rows: pa.Table) -> pa.Table:
    ids, raw = rows.column("rep").to_numpy(), rows.column("s").to_pylist()
    once = {(k, x): None for k, x in sorted(zip(ids.tolist(), raw, strict=True))}  # a row of the hub block may come twice
    ids = np.array([k for k, _ in once], np.int64)
    label = link_sets([np.frombuffer(x, np.uint64) for _, x in once])
    return pa.table({"src": pa.array(ids, pa.int64()), "dst": pa.array(ids[label], pa.int64())})


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = sets_of(b.column("text"))
        h1, h2 = digests(sets)
        same = (h1 == b.column("h1").to_numpy(zero_copy_only=False)) & (h2 == b.column("h2").to_numpy(zero_copy_only=False))
        out = b.drop_columns(["text", "h1", "h2"])
        out = out.append_column("s", pa.array([s.tobytes() for s in sets], pa.binary()))
        yield out.filter(pa.array(same))


def _numbered(rep: str, one: str, two: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The number and two digests of each text's class, in columns of these names beside the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            h1, h2 = digests(sets_of(b.column("text")))
            for name, x in ((rep, (h1 & np.int64(_LOW)) + np.int64(NAMELESS)), (one, h1), (two, h2)):
                b = b.append_column(name, pa.array(x))
            yield b

    return rows


_LOW = (1 << 61) - 1


def cluster_components(documents: DataFrame, members: DataFrame, n_members: int, n_wide: int) -> DataFrame:
    """rep, component.  documents: doc_id, text; members: rep, h1, h2, cluster, blocks, block; n_wide: clusters of several blocks."""
    per_cluster = 64 * n_wide
    m = members.withColumnRenamed("rep", "doc_id")
    joined = documents.join(sized_broadcast(m, 80 * n_members), "doc_id")
    sets = joined.select(F.col("doc_id").alias("rep"), "cluster", "blocks", "block", "h1", "h2", "text").mapInArrow(_member_sets, "rep long, cluster long, blocks long, block long, s binary")
    small = sets.filter("blocks = 1").groupBy("cluster").applyInArrow(_link, "src long, dst long").select(F.col("src").alias("rep"), F.col("dst").alias("component"))
    if n_wide == 0:
        return small
    wide = cut(sets.filter("blocks > 1"))
    # the hub block meets every block
    meet = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    hub = cut(wide.withColumn("other", F.explode(meet)).groupBy("cluster", "other").applyInArrow(_link, "src long, dst long").filter("src != dst"))
    found = connected_components(hub)
    state = wide.select("rep", "cluster", "blocks").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = state.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"))
    rest = state.join(sized_broadcast(main, per_cluster), "cluster").filter("component != main.component")
    many = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("rows"))
    rest = cut(rest.join(sized_broadcast(many, per_cluster), "cluster").select("rep", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rows")).alias("row")))
    left = wide.join(rest, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = wide.join(sized_broadcast(many, per_cluster), "cluster").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("other", F.col("block"))
    pick = ["rep", "cluster", "row", "other", "s"]
    more = left.select(*pick).unionByName(right.select(*pick)).groupBy("cluster", "row", "other").applyInArrow(_link, "src long, dst long").filter("src != dst")
    return small.unionByName(connected_components(hub.unionByName(more)).select(F.col("id").alias("rep"), "component"))


def _judged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and h1, h2, n (rows), rep and component of every class that is not empty; both checkpointed."""
    print_ = cut(documents.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"))
    rep = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.col("h1").bitwiseAND(F.lit(_LOW)))
    classes = cut(print_.filter("n_shingles > 0").groupBy("h1", "h2").agg(rep.alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("n")))
    clusters = connected_components(candidate_links(classes))
    found = cut(clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "h1", "h2", "size"), "rep"))
    # only clusters of several blocks need their size, at most one a BLOCK_DOCS members or BLOCK_SHINGLES shingles
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    wide = cut(found.groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1"))
    n_wide = wide.count()
    members = found.join(sized_broadcast(wide, 64 * n_wide), "cluster", "left").select("rep", "h1", "h2", "cluster", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))
    members = members.withColumn("block", F.when(F.col("blocks") == 1, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("rep", "h1"), F.col("blocks"))))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    if found.filter(F.col("rep") >= NAMELESS).limit(1).count():
        nameless = documents.filter("doc_id IS NULL").select("text").mapInArrow(_numbered("doc_id", "h1", "h2"), "text string, doc_id long, h1 long, h2 long")
        texts = texts.unionByName(nameless.select("doc_id", "text"))
    linked = cluster_components(texts, members, found.count(), n_wide)
    # a doc_id of several texts is one node: it links the classes of its texts
    named = print_.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2")
    several = cut(named.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("n")).filter("a != b").select("doc_id", "n"))
    if several.limit(1).count():
        same = spread_join(named, several, ["doc_id"], "h1").select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
        linked = connected_components(linked.unionByName(same.select(F.col("doc_id").alias("rep"), F.col("rep").alias("component"))), "rep", "component").withColumnRenamed("id", "rep")
    # written, so that the rows of a large group of copies are dealt in a join with it
    return print_, cut(classes.select("h1", "h2", "n", "rep").join(linked, "rep", "left").select("h1", "h2", "n", "rep", F.coalesce("component", "rep").alias("component")))


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    print_, by_class = _judged(documents)
    own = ["doc_id", "n_shingles"]
    joined = spread_join(print_.filter("n_shingles > 0").select(*own, "h1", "h2"), by_class.select("h1", "h2", "n", "component"), ["h1", "h2"], "doc_id").select(*own, "component")
    rows = joined.unionByName(print_.filter("n_shingles = 0").select(*own, F.col("doc_id").alias("component")))
    rows = rows.select(*own, F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(documents: DataFrame) -> DataFrame:
    """One row of each component, all columns: one of its smallest doc_id, or, if no row of it has a doc_id, of its least class.

    Rows without a word, linked with nothing, all stay.
    """
    print_, by_class = _judged(documents)
    key, rep, h1, h2 = fresh(documents, "key", "rep", "h1", "h2")
    named, nameless = documents.filter("doc_id IS NOT NULL"), documents.filter("doc_id IS NULL")
    ids = spread_join(print_.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2"), by_class.select("h1", "h2", "n", "component"), ["h1", "h2"], "doc_id")
    ids = cut(ids.groupBy("doc_id").agg((F.min("component") != F.col("doc_id")).alias("lost"), F.count("*").alias("n")))
    gone = ids.filter("lost").select(F.col("doc_id").alias(key))
    stay = named.join(gone, named["doc_id"].cast("long") == F.col(key), "left_anti")
    if ids.filter("n > 1 AND NOT lost").limit(1).count():
        word = stay["text"].rlike(r"[^\x20\x09-\x0D]") & stay["text"].isNotNull()
        stay = stay.filter(word).dropDuplicates(["doc_id"]).unionByName(stay.filter(~word | stay["text"].isNull()))
    if not nameless.limit(1).count():
        return stay
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    keyed = nameless.mapInArrow(_numbered(rep, h1, h2), f"{fields}, `{rep}` long, `{h1}` long, `{h2}` long")
    last = by_class.filter("rep >= 0 AND component = rep").filter(F.col("rep") >= NAMELESS).select(F.col("h1").alias(h1), F.col("h2").alias(h2))
    own = keyed.join(last, [h1, h2], "left_semi").dropDuplicates([h1, h2])
    blank = keyed.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return stay.unionByName(own.unionByName(blank).select(*documents.columns))
