r"""Personal data: strict formats as seeds, and contexts bootstrapped from them for identifiers that no format covers.

Base spans come from four strict formats.  The words before them are lexical
patterns (a label such as `phone:`, or else two words).  All identifier-like
strings and the patterns they stand in make a graph, which Spark scores in
rounds: a pattern is as sure as the share of all its places in the corpus where
a trusted instance follows, an instance as sure as its sure patterns together
(noisy or), and instances trusted in one round lend weight to further patterns
in the next.  At the end, unseen strings that fit a kind and stand in its sure
patterns become spans too; base spans always stay.

Everything is DataFrame functions: no Python worker runs.  A match's place is
the running length of the pieces between matches, summed in blocks so that time
grows little faster than the number of matches; the patterns are written so
that no text makes them search twice (possessive runs that start where a run of
their characters starts), with the same leftmost matches as the plain formats.
Texts are read once for strings and once to count all places of the patterns
in question (those that a part of the corpus does not already prove unsure),
and never shuffled.  Joins deal hot keys over tasks.

Defined results: a null or empty text has no spans; places are in code points,
ends exclusive; repeated rows and equal or missing doc_ids are rows of their
own; kinds of one string with equal sureness go by the order of KINDS; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized_broadcast, spread_join

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL, _BLANK = "A-Za-z0-9._%+-", "A-Za-z0-9-", r"\x20\x09-\x0D"
FORMATS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text holds no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"
WORD = rf"[^{_BLANK}]+"
#: A word with a digit or @, and groups of digits after it.
STRING = rf"(?<![^{_BLANK}])[^0-9@{_BLANK}]*+[0-9@][^{_BLANK}]*+(?:\x20[(+]?[0-9][0-9().+-]*+(?=[{_BLANK},;:!?\"']|$))*+"

#: Distinct strings that a pattern needs, and trusted ones among them; share of a pattern's places and sureness of an instance that count; rounds.
MIN_STRINGS, MIN_TRUSTED, SURE_PATTERN, SURE_INSTANCE, ROUNDS = 5, 5, 0.5, 0.6, 3
#: One in so many documents is counted first: patterns that its places alone prove unsure are not counted further.
FIRST_PART = 16
#: Matches whose lengths are summed as one block.
BLOCK = 128


def running(lengths: Column) -> Column:
    """Running sums of an array of longs."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.lit(0).cast("long")
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    block = lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK)
    before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda a, x: a + x)), F.array(zero), grow)
    sums = F.flatten(F.transform(blocks, lambda b: F.slice(F.aggregate(block(b), F.array(F.get(before, b)), grow), 2, BLOCK)))
    return F.when(F.size(lengths) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def matched(rows: DataFrame, text: str, pattern: str, name: str, needs: str = "") -> DataFrame:
    """rows with arrays <name> (matches), <name>_gaps (texts between them) and <name>_ends (their ends)."""
    may = F.contains(F.col(text), F.lit(needs)) if needs else F.lit(True)
    rows = rows.withColumn(name, F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(f"{name}_gaps", F.when(F.size(name) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    # the gaps are an argument here: inside a lambda their one mention would be computed anew for every match
    both = F.zip_with(name, F.slice(f"{name}_gaps", 1, F.size(name)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
    rows = rows.withColumn(f"{name}_ends", both)
    return rows.withColumn(f"{name}_ends", running(F.col(f"{name}_ends")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]++", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's format is one of its identifiers."""
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & F.call_function("luhn_check", digits(value))
    return F.length(digits(value)).between(8, 15) if kind == "phone" else F.lit(True)


def fits(value: Column) -> Column:
    """Mask of the kinds that a string which is no base span may be."""
    n = F.length(digits(value))
    could = [F.contains(value, F.lit("@")), value.rlike(r"^[0-9a-f]{0,4}(?:[.:][0-9a-f]{0,4}){2,7}$"), n.between(12, 19) & value.rlike(r"^[0-9](?:[\x20-]?[0-9])*+$"), n.between(7, 15) & value.rlike(r"^[+(]?[0-9][0-9\x20().+-]*+$")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(could)), F.lit(0))


def label(before: Column, last: Column) -> Column:
    """The pattern of two words: the second alone if it is a label, else both."""
    return F.when(last.rlike(".[:=]$"), last).otherwise(F.concat(before, F.lit(" "), last))


def _base(kind: str) -> Column:
    """The valid ones of a kind's matches as spans."""
    end = lambda i: F.get(f"{kind}_ends", i)
    spans = F.transform(kind, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end(i) - F.length(m)).alias("start"), end(i).alias("end"), m.alias("value")))
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def _seed(core: Column) -> Column:
    """The kind of base span that a string holds, -1 for none."""
    holds = lambda k: F.exists(F.regexp_extract_all(core, F.lit(FORMATS[k]), F.lit(0)), lambda v: valid(k, v))
    return reduce(lambda other, k: F.when(holds(k), KINDS.index(k)).otherwise(other), ("card", "phone", "ip", "email"), F.lit(-1))


def scanned(documents: DataFrame) -> DataFrame:
    """rid, doc_id, base (kind, start, end of each base span) and strings (place, kind, mask and pattern of each identifier-like string)."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = matched(rows, "text", FORMATS[kind], kind, NEEDS[kind])
        rows = rows.withColumn(kind, _base(kind)).drop(f"{kind}_gaps", f"{kind}_ends")
    base = F.transform(F.concat(*KINDS), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = matched(rows.select("doc_id", "text", base.alias("base")), "text", STRING, "m")
    # the two words before each string, # for one with a digit or @, ^ for the start of the text
    words = F.transform(F.slice("m_gaps", 1, F.size("m")), lambda g: F.regexp_extract_all(F.lower(g), F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("w", words)

    def string(m: Column, i: Column) -> Column:
        w, none = F.get("w", i), F.when(i == 0, "^").otherwise("#")
        left = F.regexp_replace(m, "^[^A-Za-z0-9+(@]++", "")
        core = F.regexp_replace(left, "(?<=[A-Za-z0-9)])[^A-Za-z0-9)]++$", "")
        start = F.get("m_ends", i) - F.length(left)
        pattern = F.when(F.size(w) > 0, label(F.when(F.size(w) > 1, F.element_at(w, -2)).otherwise(none), F.element_at(w, -1)))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), F.lower(core).alias("value"), _seed(core).alias("seed"), pattern.alias("pattern"))

    strings = F.filter(F.transform("m", string), lambda s: s["pattern"].isNotNull())
    strings = F.transform(strings, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.md5(s["value"].cast("binary")).alias("instance"), s["seed"].alias("seed"), fits(s["value"]).alias("fits"), s["pattern"].alias("pattern")))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", strings.alias("strings"))


def places(documents: DataFrame, patterns: DataFrame, count: int) -> DataFrame:
    """pattern and total: how often its words stand anywhere in the corpus; patterns: pattern and key, xxhash64 of it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    plain = F.transform("w", lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(w))
    keys = F.zip_with(F.slice(F.concat(F.array(F.lit("^")), "w"), 1, F.size("w")), "w", lambda a, b: F.xxhash64(label(a, b)))
    rows = documents.select(words.alias("w")).select(plain.alias("w")).select(F.explode(keys).alias("key"))
    # counted per task before the shuffle; a side of at most `count` longs and strings
    return rows.join(sized_broadcast(patterns, 128 * count), "key").groupBy("pattern").agg(F.count("*").alias("total"))


def graph(documents: DataFrame, occurrences: DataFrame) -> DataFrame | None:
    """pattern, total, instance, seed, fits and n (occurrences) of all patterns with enough strings; None if there are none."""
    edges = cut(occurrences.groupBy("pattern", "instance", "seed", "fits").agg(F.count("*").alias("n")))
    usable = F.when((F.col("seed") >= 0) | (F.col("fits") > 0), F.col("n"))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("strings"), F.count(usable).alias("usable"), F.sum(usable).alias("times"))
    enough = cut(enough.filter((F.col("strings") >= MIN_STRINGS) & (F.col("usable") >= MIN_TRUSTED)).withColumn("key", F.xxhash64("pattern")))
    count = enough.count()
    if count:
        # a pattern is sure of times / total at most, and a part of the corpus has no more places than the whole
        least = places(documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_PART)) == 0), enough.select("pattern", "key"), count)
        may = F.col("times") >= SURE_PATTERN * (F.coalesce("total", F.lit(0)) + 1)
        enough = cut(enough.join(least, "pattern", "left").filter(may).drop("total"))
        count = enough.count()
    if not count:
        return None
    totals = cut(places(documents, enough.select("pattern", "key"), count).join(enough, "pattern").select("pattern", "total", F.col("strings").alias("n")))
    return cut(spread_join(edges.withColumnRenamed("n", "times"), totals, ["pattern"], "instance").select("pattern", "total", "instance", "seed", "fits", F.col("times").alias("n")))


def _sure_patterns(edges: DataFrame, trusted: DataFrame | None) -> DataFrame:
    """pattern, kind, sure and n (strings) of the patterns that trusted instances follow often enough."""
    seeds = edges.filter("seed >= 0").select("pattern", "total", "n", F.col("seed").alias("kind"), F.lit(1.0).alias("trust"))
    if trusted is not None:
        seeds = seeds.unionByName(trusted.select("pattern", "total", "n", "kind", "trust"))
    scored = seeds.groupBy("pattern", "total", "kind").agg(F.sum(F.col("n") * F.col("trust")).alias("weight"), F.count("*").alias("trusted"))
    sure = F.col("weight") / (F.col("total") + 1)
    return scored.filter((F.col("trusted") >= MIN_TRUSTED) & (sure >= SURE_PATTERN)).select("pattern", "kind", F.least(sure, F.lit(0.999)).alias("sure"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame] | None:
    """Sure patterns (pattern, kind, sure) and the edges they accept (pattern, instance, kind, n); None where no pattern is sure."""
    unseen = edges.filter("seed < 0 AND fits > 0")
    found = trusted = None
    for _ in range(rounds):
        patterns = cut(_sure_patterns(edges, trusted))
        count = patterns.count()
        if not count:
            break
        stands = unseen.join(sized_broadcast(patterns, 128 * count), "pattern").filter(F.expr("fits & shiftleft(1, kind) > 0"))
        sureness = stands.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("sure"))))).alias("trust")).filter(F.col("trust") >= SURE_INSTANCE)
        best = cut(sureness.groupBy("instance").agg(F.max_by(F.struct("kind", "trust"), F.struct("trust", -F.col("kind"))).alias("b")).select("instance", "b.*"))
        size = 128 * best.count()
        found = patterns, stands.join(sized_broadcast(best.drop("trust"), size), ["instance", "kind"]).select("pattern", "instance", "kind", "n")
        # all edges of a trusted instance lend weight to patterns of the next round
        degree = unseen.join(sized_broadcast(best, size), "instance").groupBy("instance", "kind", "trust").agg(F.count("*").alias("n"))
        trusted = cut(spread_join(unseen.withColumnRenamed("n", "times"), cut(degree), ["instance"], "pattern").select("pattern", "total", "instance", F.col("times").alias("n"), "kind", "trust"))
    return found


def _apart(added: DataFrame, docs: DataFrame, count: int) -> DataFrame:
    """The added spans (rid, kind, start, end) that touch no base span of their row."""
    base = docs.join(sized_broadcast(added.select("rid").distinct(), 16 * count), "rid", "left_semi").select("rid", F.explode("base").alias("b")).select("rid", "b.*", F.lit(True).alias("base"))
    w = Window.partitionBy("rid").orderBy("start", "end")
    both = added.withColumn("base", F.lit(False)).unionByName(base)
    both = both.withColumn("behind", F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("ahead", F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return both.filter("NOT base AND coalesce(behind <= start, true) AND coalesce(ahead >= end, true)").select("rid", "kind", "start", "end")


def learn(documents: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Scanned rows, occurrences of strings that stand in a pattern, and what bootstrap finds."""
    docs = cut(scanned(documents))
    occurrences = docs.select("rid", F.explode("strings").alias("s")).select("rid", "s.*")
    edges = graph(documents, occurrences)
    return docs, occurrences, None if edges is None else bootstrap(edges)


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base and added: the spans of every row as arrays of kind (place in KINDS), start and end."""
    docs, occurrences, found = learn(documents)
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    if found is None:
        return docs.select("doc_id", "base", none.alias("added"))
    accepted = cut(found[1])
    stands = cut(spread_join(occurrences.filter("seed < 0"), accepted, ["pattern", "instance"], "rid").select("rid", "kind", "start", "end"))
    count = stands.count()
    added = _apart(stands, docs, count).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return docs.join(sized_broadcast(added, 64 * count), "rid", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, base spans of each kind counted, SHA-256 of the base spans and all spans as kind:start:end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
