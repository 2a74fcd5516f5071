"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets and
star-shaped candidate edges, confirmed on full shingle sets.

1. One pass hashes every text's words and shingles.  A text's set has a 128-bit name; texts with equal sets
   are one class from then on, so copies cost nothing further, however many there are.
2. One permutation spreads a set over ``bands * rows`` bins, each keeping its least value.  An empty bin takes
   that of the bin a universal hash sequence of its number finds first (Shrivastava 2017).  Bands of bins
   are bucket keys.
3. Within a bucket, edges go to one centre only: the class that shares buckets with most others, which in a
   group of edited copies is the text they were edited from.  So a bucket of n classes gives n - 1 candidate
   pairs, never n squared.
4. Candidates are confirmed by exact intersections of full sets.  Classes of a bucket that ended in different
   components get another star and a chain for a few rounds, which only make the last step cheap.
5. All classes of buckets that still hold several components are then joined exactly: shingles in order of
   rarity, a prefix of each set, and a bound by position.  No pair that reaches the share and has a bucket in
   common is left in two components, whoever its neighbours are.

Defined results: null texts and texts without words have an empty set, link with nothing and keep their
own id; a null id never becomes a component id while its group has another; repeated rows are copies;
ties are broken by the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import LEAST_HOT, components, ship, spread_join, stage, tidy

BANDS, ROWS = 32, 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | bytes | None, k: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; of all its words if it has fewer."""
    if not text:
        return np.empty(0, np.uint64)
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(memo) > 100_000:
        memo.clear()
    m = max(1, len(words) - k + 1)
    out = np.full(m, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        out = mixed(out * _B + h[j : j + m])
    return np.unique(out)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of one set: one-permutation bins, densified, hashed by bands."""
    bins = bands * rows
    h = mixed(shingles ^ _B)
    at = (h >> np.uint64(40)).astype(np.int64) % bins
    low = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, at, h)
    full = np.zeros(bins, bool)
    full[at] = True
    empty = np.flatnonzero(~full)
    tries = np.ones(1, np.uint64)
    values = low.copy()
    while len(empty):  # each empty bin walks its own universal hash sequence to the first full bin
        to = (mixed((empty.astype(np.uint64) + np.uint64(1)) * _A + tries * _B) >> np.uint64(20)).astype(np.int64) % bins
        hit = full[to]
        values[empty[hit]] = low[to[hit]]
        empty = empty[~hit]
        tries = tries + np.uint64(1)
    values = values.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _A
    for r in range(rows):
        key = mixed(key * _B + values[:, r])
    return key


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, its text's hash, n_shingles, set name (s1, s2; null for empty sets), band keys."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            n, s1, s2, keys = [], [], [], []
            for text in batch.column(2):
                s = shingle_hashes(text.as_py(), k, memo)
                n.append(len(s))
                if len(s):
                    d = xxhash.xxh3_128(s.tobytes()).intdigest()
                    s1.append((d >> 64) - (1 << 63))
                    s2.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    keys.append(band_keys(s, bands, rows).view(np.int64))
                else:
                    s1.append(None)
                    s2.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "th", "n_shingles", "s1", "s2", "bands"],
            )

    return src.mapInArrow(tidy(run), "doc_id long, th long, n_shingles long, s1 long, s2 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of the *wanted* classes (cid, rep, th), from the one row each of them names."""
    src = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    same = src["rep"].eqNullSafe(wanted["rep"]) & (src["th"] == wanted["th"])
    rows = src.join(wanted, same).select("cid", "text")

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), k, memo).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return rows.mapInArrow(tidy(run), "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The *edges* (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = edges.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                common = int((t[at] == s).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"]
            )

    return both.mapInArrow(tidy(run), "a long, b long")


def open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs of *members* (cid, n_shingles, root) of different roots that can reach *percent*.

    In one total order of the shingles, rarest first, sets x and y with 100 * common >= percent * union have
    their first common shingle at places i and j (from 0) with common <= min(|x| - i, |y| - j); pairs that no
    common shingle lets pass cannot reach it.  Shingles of one set only come first and need no shuffle.
    """

    def run(batches):
        for batch in batches:
            cids = batch.column(0).to_numpy()
            for at in range(0, len(cids), 200):
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)[at : at + 200]]
                cid = np.repeat(cids[at : at + 200], [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.concatenate(found))], ["cid", "shingle"])

    flat = stage(sets.mapInArrow(tidy(run), "cid long, shingle long"), "shingles")
    shared = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = spread_join(flat, shared.withColumn("rows", F.col("n")), ["shingle"], "rows", flat.count())
    own = held.groupBy("cid").agg(F.count(F.lit(1)).alias("n_shared"))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("n", "shingle"))
    held = held.withColumn("rank", rank).join(own, "cid").join(members, "cid")
    held = held.withColumn("left", F.col("n_shared") - F.col("rank") + 1).where(100 * F.col("left") >= percent * F.col("n_shingles"))
    held = stage(held.select("shingle", "cid", "root", F.col("n_shingles").alias("size"), "left"), "prefixes")
    # every pair of two roots has a member outside the shingle's largest root: its members never meet each other
    per = held.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    major = per.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("rows")).where("roots > 1")
    parts = (F.floor(F.col("rows") / LEAST_HOT) + 1).cast("int").alias("parts")
    held = stage(spread_join(held, major.select("shingle", F.col("m.root").alias("major"), parts, "rows"), ["shingle"], "rows", held.count()), "shared-prefixes")
    # a common shingle's rows are dealt over parts, and those outside its largest root sent to each of them
    x = held.where("root <> major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    y = held.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).alias("y")
    reach = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.size") + F.col("y.size"))
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part"))
    pairs = x.join(y, same & (F.col("x.root") != F.col("y.root")) & reach)
    return pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def link_classes(docs: DataFrame, classes: DataFrame, k: int, percent: int, rounds: int = 3) -> DataFrame:
    """(node, root) of the classes in groups of more than one; *rounds* of stars decide cost and not results."""
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  sizes that can reach it
    held = classes.select("cid", "n_shingles", F.explode("bands").alias("key"))
    crowd = held.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    held = held.join(crowd, "key")
    degree = held.groupBy("cid").agg(F.sum("crowd").alias("degree"))
    held = stage(held.join(degree, "cid").select("key", "cid", "n_shingles", "degree"), "buckets")
    best = F.max(F.struct("degree", (-F.col("cid")).alias("order"), "cid", "n_shingles")).alias("c")
    links, label, tried = None, None, None
    for turn in range(rounds):
        rows = held.withColumn("root", F.col("cid"))
        if label is not None:
            rows = held.join(label, held["cid"] == label["node"], "left").select(held["*"], F.coalesce("root", "cid").alias("root"))
            mixed_ = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
            # one member stands for a component in a bucket; open_pairs tries the others
            rows = rows.join(mixed_.select("key"), "key")
            per = rows.groupBy("key", "root").agg(best)
            rows = per.select("key", "root", "c.cid", "c.n_shingles", "c.degree")
        centre = rows.groupBy("key").agg(best)
        edges = rows.join(centre, "key").where((F.col("root") != F.col("c.cid")) & near(F.col("n_shingles"), F.col("c.n_shingles")))
        edges = edges.select(F.col("c.cid").alias("a"), F.col("cid").alias("b"))
        if label is not None:  # neighbours by size within a bucket
            chain = Window.partitionBy("key").orderBy("n_shingles", "cid")
            pairs = rows.select("cid", "n_shingles", F.lag("cid").over(chain).alias("a"), F.lag("n_shingles").over(chain).alias("na"))
            pairs = pairs.where(F.col("a").isNotNull() & near(F.col("n_shingles"), F.col("na")))
            edges = edges.unionByName(pairs.select("a", F.col("cid").alias("b")))
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if tried is not None:
            edges = edges.join(tried, ["a", "b"], "left_anti")
        edges = stage(edges, "candidates")
        nodes = edges.select(F.col("a").alias("cid")).union(edges.select(F.col("b").alias("cid"))).distinct()
        wanted = classes.join(nodes, "cid").select("cid", "rep", "th")
        found = stage(confirmed(edges, stage(sets_of(docs, wanted, k), "sets"), percent), "links")
        if label is not None and not found.take(1):
            break
        links = found if links is None else links.unionByName(found)
        tried = edges if tried is None else tried.unionByName(edges)
        label = stage(components(links, "near-cc"), "near-roots")
    rows = held.join(label, held["cid"] == label["node"], "left").select("key", "cid", "n_shingles", F.coalesce("root", "cid").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    members = stage(rows.join(several.select("key"), "key").select("cid", "n_shingles", "root").distinct(), "open")
    sets = stage(sets_of(docs, classes.join(members.select("cid"), "cid").select("cid", "rep", "th"), k), "open-sets")
    edges = stage(open_pairs(members, sets, percent).join(tried, ["a", "b"], "left_anti"), "open-pairs")
    found = stage(confirmed(edges, sets, percent), "open-links")
    if found.take(1):
        label = stage(components(links.unionByName(found), "near-cc"), "near-roots")
    return label


def decided(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, th (hash of its text), n_shingles, component_id and first_th (its group's first row; null for
    empty sets)."""
    rows = stage(signatures(docs, k), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r")
    classes = rows.where("s1 is not null").groupBy("s1", "s2").agg(
        first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")
    )
    classes = classes.select(
        F.xxhash64("s1", "s2").alias("cid"), "s1", "s2", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"), "n_shingles", "bands", "copies"
    )
    classes = stage(classes, "classes")
    label = link_classes(docs, classes, k, percent)
    linked = stage(classes.join(label, classes["cid"] == label["node"]).select("cid", "rep", "th", "root"), "linked")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "th")).alias("f")
    least = linked.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).select("root", F.col("f.rep").alias("component_id"), F.col("f.th").alias("first_th"), "n")
    linked = spread_join(linked.select("cid", "root"), least, ["root"], "n", linked.count()).select("cid", "component_id", "first_th")
    alone = F.col("first_th").isNull()
    named = classes.select("cid", "s1", "s2", "rep", "th", "copies").join(linked, "cid", "left").select(
        "s1", "s2", "copies", F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first_th", "th").alias("first_th")
    )
    named = stage(named, "named")
    return spread_join(rows.select("doc_id", "th", "n_shingles", "s1", "s2"), named, ["s1", "s2"], "copies", rows.count(), "left").drop("s1", "s2")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its group), kept.

    Documents link where 100 * intersection >= percent * union of their k-word shingle sets.
    """
    comp = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == comp, F.lit(True))
    return decided(docs, k, percent).select("doc_id", "n_shingles", comp.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """*docs* with one row of each group of near-duplicates: that of the smallest id.  Rows without words stay.

    All columns of *docs* travel inside one struct, so that none of their names can clash with those used here.
    """
    rows = stage(decided(docs, k, percent).where("first_th is not null"), "decided")
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th"))
    gone = rows.where(~is_first).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("th"))
    out = whole.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti")
    if rows.where(is_first).groupBy("component_id", "first_th").count().where("count > 1").take(1):  # whole rows repeat
        letters = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0))
        out = out.where(letters > 0).dropDuplicates(["id", "text"]).unionByName(out.where(letters == 0))
    return out.select("row.*")


ship(__name__)
