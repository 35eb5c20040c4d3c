"""Exact Jaccard join of word shingles, and its connected components.

The distance 1 - J is a metric, so a pivot's distances bound those between the
documents around it. Among unrelated texts it is 1 nearly everywhere, and there
windows around pivots hold everything; pivots can part only documents that
already overlap. The join therefore starts from coarse regions.

*Coarse regions.* Shingles fall into hashed classes, of which there are more
than two linked sets of that size can differ in elements, so two linked sets
agree in at least one class. Each document is replicated to one region for each
of its classes, keyed by the class's content; texts that merely share a passage
do not meet, as they would have to agree in a whole class. Sizes are levelled,
and a document near a level's edge also goes to the level below, if a partner
can be there. Classes in which a document is empty count only for documents
with too few others to be sure of an agreement. The surplus of classes says how
many regions a document shares with any linked one; with fewer it has no link.

*Voronoi regions.* Each coarse region's pivot is its document with the most
company, and a pivot gives way to one that it is linked with and that has more.
Documents measure their exact distance to the pivots of their coarse regions;
the nearest is a document's home. Those within the threshold of a pivot are of
one component and need no comparison among themselves. Then each document
measures the homes of all others of its coarse regions too, and is replicated to
those at most the threshold farther than its own home. Of two linked documents
let x be nearer to its home p than y is to its own: by the triangle inequality y
is at most the threshold farther from p than x, so it is replicated there and
they meet. Where a coarse region has more than ``HOMES`` homes its documents do
not measure them all, but are all replicated to its own pivot.

*Recursion.* In a Voronoi region of more than ``LEAF`` documents some of these
become pivots, all others measure all of them, and the same windows split it
again, until regions are small or do not get smaller.

*Leaves.* What is left is centred on the first pivot: a document becomes its
deviation, the shingles in which it differs from the pivot, and two documents
differ exactly where their deviations differ. By the triangle inequality two
linked documents, one of them beyond the threshold, have deviations whose sizes
differ little and that overlap in a known number of shingles, so they meet in
one of the first of these in the order of their frequency in the region. Where
they meet first, what is left of both in that order has to hold all that they
share. What meets like that is compared, so no link is lost and a region's
documents are not all compared with each other.

Sets are compared as 64-bit shingle hashes, whole. Texts of equal sets, such as
copies, are one node. A null or empty text or one without words has no shingles,
is linked with nothing and its own component; a text with fewer words than a
shingle has one shingle of all its words. A component's id is the smallest
non-null key of its rows; rows that repeat key and text are like other copies.
An empty table gives no rows. Other columns, whatever their names, are neither
read nor returned, except that :func:`one_of_each` returns the rows it keeps as
they came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialize, release, slices, table, whole

#: Homes that the documents of a coarse region measure, documents of a region that is not split, and pivots of one that is.
HOMES, LEAF, PIVOTS = 4, 512, 8
#: Documents of one component that share a shingle of a leaf and join each other; more are a crowd, which does not.
CROWD = 32
#: Edges whose nodes' least neighbours, at most two for each, are broadcast.
EDGES = 200_000
_LEVEL_RATIO = 1.5
U = np.uint64


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; sets link when inter * den >= num * union."""

    words: int = 5
    num: int = 4
    den: int = 5

    def apart(self, n: int) -> int:
        """The most elements in which a set of n, or fewer, and a larger linked one differ."""
        return n * (self.den - self.num) // self.num

    def linked(self, inter: Column, union: Column) -> Column:
        return inter * self.den >= union * self.num

    def window(self, total: Column) -> Column:
        """The most elements in which linked sets of ``total`` elements in all differ."""
        return total * (self.den - self.num) / (self.den + self.num)

    def first(self, size: Column, deviation: Column, linked: Column) -> Column:
        """How many shingles of a deviation are sure to meet those of a partner.

        Let u be a set not linked with the pivot P, v a partner, d the size of a
        deviation. As u is beyond and v within the threshold, d(u) exceeds
        |u - v| by more than -d(v) * (den - num) / (den + num), so that more
        than d(v) * num / (den + num) shingles are common. That bounds v if it
        is linked with P, as its partner is beyond. The partner of a set that is
        itself beyond can be linked with P, and then only d(u) - apart(u) common
        shingles are sure.
        """
        own = deviation - F.floor(deviation * self.num / (self.num + self.den))
        apart = F.floor(size * (self.den - self.num) / self.num)
        return F.when(linked, own).otherwise(F.least(apart + 1, deviation)).cast("int")


@lru_cache(8)
def levels(measure: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, classes, largest partner) of each level of sizes.

    So many classes that, for the level's largest sets, those with a shingle
    outnumber the differences by five standard deviations.
    """
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, math.ceil(first[-1] * _LEVEL_RATIO)))
    classes, partner = [], []
    for low, high in zip(first, first[1:], strict=False):
        n, need = high - 1, measure.apart(high - 1) + 1
        m = need
        while need > 1 and m < 40 * need:
            q = math.exp(n * math.log1p(-1 / m)) if m > 1 else 0.0
            if m * (1 - q) - 5 * math.sqrt(m * q * (1 - q)) >= need:
                break
            m += max(1, m // 50)
        classes.append(m)
        partner.append(n * measure.den // measure.num)
    return np.array(first[:-1], np.int64), np.array(classes, np.int64), np.array(partner, np.int64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x + U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mixed(np.arange(64 * 256, dtype=np.uint64), 1).reshape(64, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text); texts lie end to end."""
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    cut[ends] = True
    white = _WHITE[data]
    inner = ~white
    before = np.concatenate([[True], white[:-1]]) | cut[:-1]
    behind = np.concatenate([white[1:], [True]]) | cut[1:]
    starts = np.flatnonzero(inner & before)
    lengths = np.flatnonzero(inner & behind) + 1 - starts
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    first = np.cumsum(lengths) - lengths
    body = _LOWER[data[inner]]
    place = np.arange(len(body)) - np.repeat(first, lengths)
    value = _BYTES[place & 63, body] * (2 * (place >> 6) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text end to end, their counts)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    w, n = word_hashes(data, np.cumsum(sizes))
    factors = mixed(np.arange(words, dtype=np.uint64), 2) | U(1)
    padded = np.concatenate([w, np.zeros(words, np.uint64)])
    first = np.cumsum(n) - n
    have = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first, have)
    own = np.repeat(np.minimum(n, words), have)  # words of the shingle
    h = np.repeat(mixed(np.arange(words + 1, dtype=np.uint64), 3), 1)[own]
    for i in range(words):
        h = h + np.where(i < own, padded[at + i] * factors[i], U(0))
    h = mixed(h, 4)
    ends = np.cumsum(have)
    for a, b in zip((ends - have).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[(ends - have)[have > 0]] = True
    owner = np.repeat(np.arange(len(texts)), have)
    return h[fresh], np.bincount(owner[fresh], minlength=len(texts))


def identities(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums that are a set's key, and one word of both."""
    sums = [np.zeros(len(counts), np.uint64) for _ in range(2)]
    full = counts > 0
    first = (np.cumsum(counts) - counts)[full]
    for salt, s in enumerate(sums):
        if len(first):
            s[full] = np.add.reduceat(mixed(h, 5 + salt), first)
    a, b = sums
    return a, b, mixed(a ^ mixed(b, 7))


def signatures(h: np.ndarray, counts: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures of each set end to end, their counts, how many a linked set shares at least)."""
    low, classes, partner = levels(measure)
    spread, value = mixed(h, 8) >> U(24), mixed(h, 9)
    level = np.searchsorted(low, counts, "right") - 1
    starts = np.cumsum(counts) - counts
    found, owners, least = [], [], np.full(len(counts), np.iinfo(np.int32).max)
    docs, at = np.flatnonzero(counts > 0), level[counts > 0]
    while len(docs):
        m, n = classes[at], counts[docs]
        base = np.cumsum(m) - m
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[docs], n)
        cell = np.repeat(base, n) + (spread[place] % np.repeat(m, n).astype(np.uint64)).astype(np.int64)
        content = np.zeros(m.sum(), np.uint64)
        np.add.at(content, cell, value[place])
        filled = np.bincount(cell, minlength=len(content)) > 0
        differ = np.minimum(n, low[np.minimum(at + 1, len(low) - 1)] - 1) * (measure.den - measure.num) // measure.num
        sure = np.add.reduceat(filled, base, dtype=np.int64) - differ
        unsure = sure <= 0
        least[docs] = np.minimum(least[docs], np.maximum(sure, 1))
        emit = filled | np.repeat(unsure, m)
        number = np.arange(len(content)) - np.repeat(base, m)
        tag = mixed((np.repeat(at, m) << 40 | number).astype(np.uint64), 10)
        found.append(mixed(content + tag)[emit])
        owners.append(np.repeat(docs, m)[emit])
        # the level below, for those that can have a partner there
        down = (at > 0) & (n <= partner[np.maximum(at - 1, 0)])
        docs, at = docs[down], at[down] - 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64), least
    owner, sig = np.concatenate(owners), np.concatenate(found)
    return sig[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(counts)), least


def _key(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    both = np.stack([a, b], axis=1).astype(">u8")
    return [x.tobytes() if n else None for x, n in zip(both, counts.tolist(), strict=True)]


def _listed(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.view(np.int64)))


def describe(df: DataFrame, id_col: str, text_col: str, measure: Measure) -> DataFrame:
    """id, h, n_shingles, key, node, row, least, sigs of each row, written to the shared folder.

    A task gives the signatures of equal sets once, else none. Rows are numbered
    within tasks, so that their numbers shuffle in less space than nodes.
    """
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("h"), whole(text_col).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        row = TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in slices(batch, 2)):
            h, counts = shingle_sets(part.column(2).to_pylist(), measure.words)
            a, b, node = identities(h, counts)
            if len(seen) > 1_000_000:
                seen.clear()
            new = np.zeros(len(counts), bool)
            for i, x in enumerate(node.tolist()):
                if counts[i] and x not in seen:
                    seen.add(x)
                    new[i] = True
            sig, many, few = signatures(h[np.repeat(new, counts)], counts[new], measure)
            own = np.zeros(len(counts), np.int64)
            own[new] = many
            least = np.zeros(len(counts), np.int32)
            least[new] = few
            columns = [part.column(0), part.column(1), pa.array(counts.astype(np.int64)), pa.array(_key(a, b, counts), pa.binary()), pa.array(node.view(np.int64)), pa.array(row + np.arange(len(counts))), pa.array(least), _listed(sig, own)]
            row += len(counts)
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "n_shingles", "key", "node", "row", "least", "sigs"])

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"id {kind}, h long, n_shingles long, key binary, node long, row long, least int, sigs array<long>"), "shingles")


def gather_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, measure: Measure) -> DataFrame:
    """key, node, n, items of each wanted (id, key), from the texts again."""
    wanted = broadcast_if_small(wanted.withColumnsRenamed({"id": "asked_id", "key": "asked"}), 500_000)
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("data"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("asked_id"))).select("asked", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            h, counts = shingle_sets(part.column(1).to_pylist(), measure.words)
            a, b, node = identities(h, counts)
            keys = _key(a, b, counts)
            same = np.array([k == q for k, q in zip(keys, part.column(0).to_pylist(), strict=True)], bool)
            if same.any():
                columns = [pa.array([k for k, s in zip(keys, same, strict=True) if s], pa.binary()), pa.array(node[same].view(np.int64)), pa.array(counts[same].astype(np.int64)), _listed(h[np.repeat(same, counts)], counts[same])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "items"])

    sets = materialize(rows.mapInArrow(run, "key binary, node long, n long, items array<long>"), "sets")
    # rows that repeat key and text would be compared again and again
    return sets if sets.count() == sets.select("key").distinct().count() else materialize(sets.dropDuplicates(["key"]), "sets")


def paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of ``pairs``, which are nodes, with the keys, sizes and items of both."""
    left = sets.select(F.col("node").alias("u"), F.col("key").alias("ku"), F.col("n").alias("nu"), F.col("items").alias("iu"))
    right = sets.select(F.col("node").alias("v"), F.col("key").alias("kv"), F.col("n").alias("nv"), F.col("items").alias("iv"))
    inter = F.size(F.array_intersect("iu", "iv")).cast("long")
    return pairs.join(left, "u").join(right, "v").withColumn("inter", inter)


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of all nodes of the (a, b) ``edges``, by alternating stars.

    Least neighbours are broadcast while there are few edges, else written, so
    that the join can split the edges of a hub among tasks.
    """

    def known(least: DataFrame) -> DataFrame:
        return F.broadcast(least) if now[0] <= EDGES else materialize(least, "least")

    def large(e: DataFrame) -> DataFrame:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return sym.where(F.col("b") > F.col("a")).join(known(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        least = known(e.groupBy("a").agg(F.min("b").alias("m")))
        moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, written = state(edges), False
    while now[0]:
        more = materialize(tidy(small(tidy(large(edges)))), "stars", 2 * now[0])
        if written:
            release(edges)
        edges, written = more, True
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("key"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct())


def shared_regions(listed: DataFrame) -> DataFrame:
    """The rows of ``listed`` in regions that two nodes or more are in."""
    shared = listed.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("region")
    return listed.join(shared, "region")


def distance(far: Column, nu: Column, nv: Column) -> Column:
    """1 - J of sets of nu and nv elements that differ in ``far``."""
    return 2.0 * far / (nu + nv + far)


def deviations(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """u, v, ku, kv, nu, linked, items, far, d of (u, v): how u differs from the pivot v."""
    items = F.concat(F.array_except("iu", "iv"), F.array_except("iv", "iu"))
    linked = measure.linked(F.col("inter"), F.col("nu") + F.col("nv") - F.col("inter"))
    found = paired(pairs, sets).select("u", "v", "ku", "kv", "nu", "nv", linked.alias("linked"), items.alias("items")).withColumn("far", F.size("items"))
    return found.withColumn("d", distance(F.col("far"), F.col("nu"), F.col("nv"))).drop("nv")


def voronoi(regions: DataFrame, pivots: DataFrame, labels: DataFrame, sets: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """(members, measured): the Voronoi regions, and all distances from documents to pivots.

    ``regions`` are the coarse ones, ``pivots`` theirs (region, v), and
    ``labels`` the components so far. ``members`` has u and v.
    """
    radius = (measure.den - measure.num) / measure.den + 1e-9
    seen = materialize(regions.join(pivots, "region").join(labels.withColumnRenamed("node", "u"), F.col("node") == F.col("u")).select("region", "u", "v", "label"), "seen")
    # a pivot whose documents are all of one component has nothing to compare
    open_ = seen.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    seen = materialize(seen.join(broadcast_if_small(materialize(open_, "open")), "v").select("region", "u", "v"), "seen")
    first = materialize(deviations(seen.where("u != v").select("u", "v").distinct(), sets, measure), "measured")
    own = seen.where("u = v").select("u", "v").distinct().withColumn("d", F.lit(0.0))
    nearest = first.select("u", "v", "d").unionByName(own).groupBy("u").agg(F.min(F.struct("d", "v")).alias("home"))
    homes = materialize(nearest.select("u", F.col("home.v").alias("home"), F.col("home.d").alias("near")), "homes")

    # the homes of a document's coarse regions; a coarse region of one home has nothing to replicate
    listed = seen.join(homes.select("u", "home"), "u")
    several = listed.groupBy("region").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select("region")
    listed = materialize(listed.join(several, "region"), "listed")
    held = listed.select("region", "home").distinct()
    count = held.groupBy("region").agg(F.count(F.lit(1)).alias("homes"))
    few = held.join(count.where(F.col("homes") <= HOMES), "region").select("region", "home")
    asked = listed.select("region", "u").join(few, "region").where("u != home").select("u", F.col("home").alias("v")).distinct()
    asked = materialize(asked.join(homes.select("u", "near"), "u"), "asked")
    more = asked.select("u", "v").join(first.select("u", "v"), ["u", "v"], "left_anti")
    measured = first.unionByName(materialize(deviations(more, sets, measure), "measured"))

    inside = asked.join(measured.select("u", "v", "d"), ["u", "v"]).where(F.col("d") <= F.col("near") + F.lit(radius)).select("u", "v")
    wide = listed.join(count.where(F.col("homes") > HOMES).select("region"), "region").where("u != v").select("u", "v")
    members = homes.where("u != home").select("u", F.col("home").alias("v")).unionByName(inside).unionByName(wide).distinct()
    return members, measured


def split(cells: DataFrame, measure: Measure, depth: int) -> tuple[DataFrame, DataFrame]:
    """(cells, links): the members of large Voronoi regions by pivots among themselves.

    Each is of its nearest pivot and of those at most the threshold farther. A
    region stays as it is if its parts would not be much smaller.
    """
    radius = (measure.den - measure.num) / measure.den + 1e-9
    size = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LEAF), "large")
    big = cells.join(broadcast_if_small(size), "cell")
    order = F.row_number().over(W.partitionBy("cell").orderBy("linked", F.xxhash64("u", F.lit(depth))))
    drawn = big.select("cell", "u", "linked").withColumn("n", order).where(F.col("n") <= PIVOTS).select("cell", "u")
    pivots = materialize(big.join(drawn, ["cell", "u"]).select("cell", F.col("u").alias("p"), F.col("ku").alias("kp"), F.col("nu").alias("np"), F.col("label").alias("lp"), F.col("items").alias("ip")), "pivots")
    known = broadcast_if_small(pivots, 100 * PIVOTS)  # else the join splits skewed keys
    apart = F.size(F.array_except("items", "ip")) + F.size(F.array_except("ip", "items"))
    far = big.join(known, "cell").withColumn("apart", apart)
    far = far.withColumn("dp", distance(F.col("apart"), F.col("nu"), F.col("np"))).select("cell", "size", "u", "p", "ku", "kp", "nu", "np", "label", "lp", "apart", "dp")
    far = materialize(far, "apart")
    inter = (F.col("nu") + F.col("np") - F.col("apart")) / 2
    links = far.where((F.col("label") != F.col("lp")) & measure.linked(inter, inter + F.col("apart"))).select(F.col("ku").alias("a"), F.col("kp").alias("b"))
    near = far.groupBy("cell", "u").agg(F.min("dp").alias("near"))
    parts = far.where("u != p").join(near, ["cell", "u"]).where(F.col("dp") <= F.col("near") + F.lit(radius)).select("cell", "size", "u", "p")
    sizes = parts.groupBy("cell", "p").agg(F.count(F.lit(1)).alias("part"), F.max("size").alias("size"))
    better = sizes.groupBy("cell").agg(F.max("part").alias("most"), F.sum("part").alias("sum"), F.max("size").alias("size")).where("most <= 0.7 * size AND sum <= 2 * size").select("cell")
    better = broadcast_if_small(materialize(better, "better"))
    parts = parts.join(better, "cell").select("cell", "u", F.xxhash64("cell", "p").alias("part"))
    inner = big.drop("size").join(parts, ["cell", "u"]).drop("cell").withColumnRenamed("part", "cell").withColumn("final", F.lit(False))
    stay = cells.join(better, "cell", "left_anti").join(broadcast_if_small(size.select("cell")), "cell", "left_semi").withColumn("final", F.lit(True))
    small = cells.join(broadcast_if_small(size.select("cell")), "cell", "left_anti").withColumn("final", F.lit(True))
    return small.unionByName(stay).unionByName(inner), links


def meetings(windows: DataFrame, measure: Measure) -> DataFrame:
    """cell, u, v of rows of ``windows`` that meet in an item of a cell and may be linked.

    Two documents of one component have nothing to find out. Where more than
    ``CROWD`` documents of a component share an item, these do not join with
    each other: they meet the documents outside crowds, and crowds of one item
    meet by pairs of crowds. What is linked with the pivot is one crowd.
    """
    keys = ["cell", "item", "crowd"]
    crowds = materialize(windows.groupBy(keys).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > CROWD).select(keys), "crowds")

    def side(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("cell", "item", *(F.col(c).alias(f"{c}{n}") for c in ("u", "nu", "crowd", "label", "far", "left")))

    def close(met: DataFrame) -> DataFrame:
        most = measure.window(F.col("nu1") + F.col("nu2"))
        may = (F.col("crowd1") != F.col("crowd2")) & (F.col("label1") != F.col("label2")) & (F.abs(F.col("far1") - F.col("far2")) <= most)
        # where they meet first, all that they share is in what is left of both
        may &= 2 * F.least("left1", "left2") >= F.col("far1") + F.col("far2") - most
        return met.where(may).select("cell", F.least("u1", "u2").alias("u"), F.greatest("u1", "u2").alias("v"))

    if crowds.isEmpty():
        found = close(side(windows, 1).join(side(windows, 2), ["cell", "item"]).where("u1 < u2"))
    else:
        known = broadcast_if_small(crowds)
        few, many = windows.join(known, keys, "left_anti"), windows.join(known, keys, "left_semi")
        found = close(side(few, 1).join(side(few, 2), ["cell", "item"]).where("u1 < u2"))
        found = found.unionByName(close(side(few, 1).join(side(many, 2), ["cell", "item"])))
        one, two = (crowds.withColumnRenamed("crowd", f"crowd{n}") for n in (1, 2))
        both = materialize(one.join(two, ["cell", "item"]).where("crowd1 < crowd2"), "both")
        met = side(many, 1).join(broadcast_if_small(both), ["cell", "item", "crowd1"]).join(side(many, 2), ["cell", "item", "crowd2"])
        found = found.unionByName(close(met))
    # a pair that meets in several cells is compared in one
    return found.groupBy("u", "v").agg(F.min("cell").alias("cell"))


def leaves(cells: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): keys of linked sets of a cell that are of different components so far."""
    listed = cells.select("cell", "u", F.explode("items").alias("item"))
    often = listed.groupBy("cell", "item").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = listed.join(often, ["cell", "item"]).groupBy("u", "cell").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("items"))
    ranked = cells.select("u", "cell", "nu", "linked", "label", "far").join(ranked, ["u", "cell"])
    # shingles of one document alone come first in the order and meet nobody
    alone = F.col("far") - F.size("items")
    first = F.greatest(measure.first(F.col("nu"), F.col("far"), F.col("linked")) - alone, F.lit(0))
    at = F.posexplode(F.slice("items", F.lit(1), first)).alias("pos", "i")
    windows = ranked.select("u", "cell", "nu", "linked", "label", "far", alone.alias("alone"), at)
    crowd = F.struct("linked", F.when(F.col("linked"), 0).otherwise(F.col("label")).alias("of"))
    windows = windows.select("u", "cell", "nu", crowd.alias("crowd"), "label", "far", F.col("i.item").alias("item"), (F.col("far") - F.col("alone") - F.col("pos")).alias("left"))
    windows = materialize(windows, "windows")
    pairs = materialize(meetings(windows, measure), "pairs")
    release(windows)
    # two sets differ where their deviations from the pivot do
    one, two = (cells.select("cell", F.col("u").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("ku", "nu", "items"))) for side in "uv")
    met = pairs.join(one, ["cell", "u"]).join(two, ["cell", "v"])
    apart = F.size(F.array_except("items_u", "items_v")) + F.size(F.array_except("items_v", "items_u"))
    met = met.withColumn("total", F.col("nu_u") + F.col("nu_v")).withColumn("apart", apart)
    inter = (F.col("total") - F.col("apart")) / 2
    met = met.where(measure.linked(inter, inter + F.col("apart"))).select(F.col("ku_u").alias("a"), F.col("ku_v").alias("b"))
    found = materialize(met, "links")
    release(pairs)
    return found


def links(base: DataFrame, df: DataFrame, id_col: str, text_col: str, measure: Measure) -> DataFrame:
    """(key, label) of every set that is linked with a different one."""
    # regions of several rows first, which may be copies, then those of several nodes; one exchange serves both sides
    listed = base.select("row", F.explode("sigs").alias("region")).repartition("region")
    several = listed.groupBy("region").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("region")
    regions = listed.join(several, "region").join(base.select("row", "node", "least"), "row").select("region", "node", "least").distinct()
    regions = materialize(regions, "regions")
    # a set that shares too few regions has no link
    enough = regions.groupBy("node").agg(F.count(F.lit(1)).alias("many"), F.max("least").alias("least")).where("many >= least")
    fewer = materialize(shared_regions(regions.join(enough.select("node"), "node", "left_semi")), "regions")
    release(regions)
    regions = fewer
    # a node's company: all that it shares regions with, each as often as it does
    size = regions.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    company = regions.join(size, "region").groupBy("node").agg(F.sum("size").alias("many"))
    wanted = base.join(company, "node").where("n_shingles > 0").groupBy("key").agg(F.min("id").alias("id"), F.min("node").alias("node"), F.max("many").alias("many"))
    nodes = materialize(wanted, "nodes", base.count() // 4)
    count = nodes.count()
    company = nodes.groupBy("node").agg(F.max("many").alias("many"))
    sets = gather_sets(df, nodes.select("id", "key"), id_col, text_col, measure)

    best = regions.join(company, "node").groupBy("region").agg(F.max(F.struct("many", "node")).alias("best"))
    pivots = materialize(best.select("region", F.col("best.many").alias("many"), F.col("best.node").alias("pivot")), "pivots")
    star = regions.join(pivots, "region").where("node != pivot").groupBy(F.col("node").alias("u"), F.col("pivot").alias("v")).agg(F.max("many").alias("many"))
    linked = measure.linked(F.col("inter"), F.col("nu") + F.col("nv") - F.col("inter"))
    near = materialize(paired(star, sets).where(linked).select("u", "v", "many", F.col("ku").alias("a"), F.col("kv").alias("b")), "near")

    # each node follows the linked pivot with the most company, and that one its own
    heads = near.groupBy("u").agg(F.max(F.struct("many", F.col("v").alias("node"))).alias("head"))
    own = F.struct("many", "node")
    heads = company.join(heads.withColumnRenamed("u", "node"), "node", "left").select("node", F.greatest(own, F.coalesce("head", own))["node"].alias("head"))
    heads = materialize(heads, "heads", count)
    labels = heads.join(heads.select(F.col("node").alias("head"), F.col("head").alias("label")), "head").select("node", "label")
    # pivots give way to those that they follow
    pivots = pivots.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("v")), "pivot").select("region", "v")
    members, measured = voronoi(regions.select("region", "node"), pivots, labels, sets, measure)
    edges = near.select("a", "b").unionByName(measured.where("linked").select(F.col("ku").alias("a"), F.col("kv").alias("b")))

    cells = measured.join(members, ["u", "v"]).join(labels.withColumnRenamed("node", "u"), "u")
    cells = cells.select(F.xxhash64("v").alias("cell"), "u", "ku", "nu", "linked", "label", "items", "far")
    cells = materialize(cells.withColumn("final", F.lit(False)), "cells")
    for depth in range(64):
        todo = cells.where("NOT final").drop("final")
        if todo.groupBy("cell").count().where(F.col("count") > LEAF).isEmpty():
            break
        parts, more = split(todo, measure, depth)
        cells = materialize(parts.unionByName(cells.where("final")), "cells")
        edges = edges.unionByName(more)
    more = leaves(cells, measure)
    release(regions, sets)
    return components(edges.unionByName(more))


def _assigned(df: DataFrame, id_col: str, text_col: str, measure: Measure) -> DataFrame:
    """id, h, n_shingles, component_id of each row."""
    base = describe(df, id_col, text_col, measure)
    label = links(base, df, id_col, text_col, measure)
    least = base.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    grouped = least.join(label, "key", "left").where((F.col("many") > 1) | F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "key"))
    grouped = materialize(grouped, "grouped", base.count() // 4)
    best = grouped.groupBy("label").agg(F.min("least").alias("best"))
    placed = materialize(grouped.join(best, "label").select("key", "best"), "placed", base.count() // 4)
    out = base.drop("sigs", "node", "row", "least").join(placed, "key", "left")
    return out.select("id", "h", "n_shingles", F.coalesce("best", "id").alias("component_id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = Measure()) -> DataFrame:
    """``id_col``, n_shingles and component_id of every row of ``df``."""
    return _assigned(df, id_col, text_col, measure).drop("h").withColumnRenamed("id", id_col)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = Measure()) -> DataFrame:
    """The rows of ``df`` with the smallest key of their component, as they came."""
    lost = _assigned(df, id_col, text_col, measure).where(~F.col("id").eqNullSafe(F.col("component_id")))
    key, text = fresh(df, "lost_id"), fresh(df, "lost_text")
    lost = broadcast_if_small(materialize(lost.select(F.col("id").alias(key), F.col("h").alias(text)).distinct(), "lost"))
    return df.join(lost, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(whole(text_col)) == F.col(text)), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), measure=Measure(3, 9, 10))
