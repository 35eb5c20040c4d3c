"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is its 64-bit hash. Distinct keys are counted first, by their
leading bits, and the directory grows from those counts: it starts as one
bucket, an overfull bucket splits on its next bit, and the directory doubles
when a bucket needs more bits than it has. It is kept as its buckets, each with
its depth and prefix, so it has one row for each bucket however deep the
deepest is; a key finds its bucket by one lookup for each depth that occurs.

Ranges of buckets belong to owner tasks. Every row is sent to the owner of its
bucket with its whole text, where texts of one key form a chain: they are sorted
and compared by their bytes, and only equal ones are one entry. The entries are
written to the shared folder with their bytes, and rows that come later are
looked up there, through the directory too. A row in a wrong bucket would not
meet its copies. Everything is DataFrame work: no Python runs on the executors.

A key is hot if its rows together are as large as an owner's share, or are a
thousandth of all rows. Entries of hot keys are counted before they are sent, by
key and bytes. Their rows find their entry by key and bytes too: in a broadcast
if all these entries are small, else in parts of an owner's share, each of which
has a copy of the key's chain.

A null text counts as empty, and empty texts equal each other. A null id is
smaller than any other. Rows that repeat id and text are rows of the same
group; all are returned, and those with the kept id are kept. An empty table
gives no rows. Other columns, whatever their names, are neither read nor
returned, except that :func:`drop_copies` returns the rows it keeps as they came.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .common import fresh, materialize, table, whole

#: Distinct keys of a bucket: at least the first, and so many that there are about 2 ** 18 buckets at most.
LEAST_CAPACITY, BUCKET_BITS = 4096, 18
#: Bits that the first histogram of keys resolves, and its rows' bound.
STEP_BITS = 14
#: Keys of this share of all rows are hot.
HOT_KEYS = 1000
#: Text bytes that an owner has on average at most, and a key that is not hot.
OWNER_BYTES = 64 << 20
#: What a row counts beside its text, and the bound of hot keys in a broadcast, of 16 bytes each.
ROW_BYTES, HOT_LIST = 64, 2_000_000


@dataclass(frozen=True)
class Bucket:
    """The keys whose first ``depth`` bits are ``prefix``."""

    depth: int
    prefix: int
    entries: int


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def prefix_of(key: Column, bits: int) -> Column:
    """The first bits of a 64-bit key, as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _numbers(spark: SparkSession, *columns: tuple[str, list[int]]) -> DataFrame:
    """A table of driver-side numbers, made in the JVM from one literal for each column."""
    lists = [F.split(F.lit(",".join(map(str, values))), ",").alias(name) for name, values in columns]
    zipped = spark.range(1).select(F.explode(F.arrays_zip(*lists)).alias("z"))
    return zipped.select(*(F.col(f"z.{name}").cast("long").alias(name) for name, _ in columns))


def grow_directory(keys: DataFrame, capacity: int) -> list[Bucket]:
    """The buckets with keys, in the order of their keys; ``keys`` has distinct ``h``.

    None has more than ``capacity`` keys. Splits go on up to all 64 bits, where
    a bucket is one key. Each round counts the keys of overfull buckets by some
    bits more, fewer if many are overfull, so the driver gets at most about
    2 ** (BUCKET_BITS + 2) counts a round.
    """
    known, done, overfull = 0, [], [Bucket(0, 0, -1)]
    while overfull:
        step = max(1, min(STEP_BITS, BUCKET_BITS + 2 - len(overfull).bit_length(), 64 - known))
        under = keys
        if known:
            prefixes = _numbers(keys.sparkSession, ("over", [_signed(b.prefix) if b.depth == 64 else b.prefix for b in overfull]))
            under = keys.join(F.broadcast(prefixes), prefix_of(F.col("h"), known) == F.col("over"), "left_semi")  # overfull buckets, each with more than the capacity
        known += step
        rows = under.groupBy(prefix_of(F.col("h"), known).alias("p")).count().collect()
        sums = {known: {r["p"] & (1 << 64) - 1: r["count"] for r in rows}}
        for bits in range(known - 1, known - step - 1, -1):
            sums[bits] = {}
            for p, n in sums[bits + 1].items():
                sums[bits][p >> 1] = sums[bits].get(p >> 1, 0) + n
        todo, overfull = overfull, []
        while todo:
            b = todo.pop()
            b = Bucket(b.depth, b.prefix, sums[b.depth].get(b.prefix, 0))
            if b.entries <= capacity or b.depth == 64:
                done += [b] * (b.entries > 0)
            elif b.depth == known:
                overfull.append(b)
            else:  # split on the next bit
                todo += [Bucket(b.depth + 1, 2 * b.prefix, -1), Bucket(b.depth + 1, 2 * b.prefix + 1, -1)]
    return sorted(done, key=lambda b: b.prefix << (64 - b.depth))


@dataclass(frozen=True)
class Directory:
    """Buckets, the number of owners, the rows that were counted, and their hot keys (h), if any."""

    spark: SparkSession
    buckets: list[Bucket]
    owners: int
    rows: int
    hot: DataFrame | None

    def find(self, rows: DataFrame, key: str = "h") -> DataFrame:
        """``rows`` with bucket and owner, who has consecutive buckets; null where no bucket has the key."""
        bucket, taken = F.lit(None).cast("long"), []
        for depth in sorted({b.depth for b in self.buckets}):
            mine = [(i, b) for i, b in enumerate(self.buckets) if b.depth == depth]
            prefix, number = f"prefix_{depth}", f"number_{depth}"
            at = _numbers(self.spark, (prefix, [_signed(b.prefix) if depth == 64 else b.prefix for _, b in mine]), (number, [i for i, _ in mine]))
            # a row for each bucket: their number is bounded by the capacity
            rows = rows.join(F.broadcast(at), prefix_of(F.col(key), depth) == F.col(prefix), "left")
            bucket, taken = F.coalesce(F.col(number), bucket), [*taken, prefix, number]
        owner = F.floor(F.col("bucket") * self.owners / max(1, len(self.buckets))).cast("int")
        return rows.withColumn("bucket", bucket).drop(*taken).withColumn("owner", owner)

    def owned(self, rows: DataFrame) -> DataFrame:
        """``rows`` in the tasks of their owners."""
        return self.find(rows).repartitionById(self.owners, F.col("owner"))

    def cold(self, rows: DataFrame) -> DataFrame:
        return rows if self.hot is None else rows.join(self.hot, "h", "left_anti")

    def of_hot(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.hot, "h", "left_semi")

    def find_hot(self, rows: DataFrame, entries: DataFrame, how: str = "inner") -> DataFrame:
        """Hot ``rows`` with their entries of the same key and bytes.

        A row's part of its key follows from its other columns; rows that differ in none share one.
        """
        if (entries.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0) <= OWNER_BYTES:
            return rows.join(F.broadcast(entries), ["h", "text"], how)
        part, parts = fresh(rows, "part"), fresh(rows, "parts")
        hot = self.hot.withColumnRenamed("parts", parts)
        copies = entries.join(hot, "h").withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
        others = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns if c != "text"))
        spread = rows.join(hot, "h").withColumn(part, F.pmod(others, F.col(parts)).cast("int")).drop(parts)
        return spread.join(copies, ["h", "text", part], how).drop(part)


def build_directory(df: DataFrame, text_col: str, capacity: int | None, hash_of: Callable[[Column], Column]) -> Directory:
    spark, text = df.sparkSession, whole(text_col)
    keys = df.select(hash_of(text).alias("h"), F.octet_length(text).cast("long").alias("bytes"))
    keys = materialize(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), "keys")
    sums = keys.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes")).first()
    rows = sums["rows"] or 0
    size = F.col("bytes") + F.col("n") * ROW_BYTES
    shared = (F.col("n") >= 2) & ((F.col("n") >= rows / HOT_KEYS) | (size >= OWNER_BYTES))
    hot = keys.where(shared).select("h", F.ceil(size / OWNER_BYTES).cast("int").alias("parts"))
    found = hot.count()
    buckets = grow_directory(keys, capacity or max(LEAST_CAPACITY, sums["keys"] >> BUCKET_BITS))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sums["bytes"] or 0) // OWNER_BYTES)
    return Directory(spark, buckets, max(1, min(len(buckets), owners)), rows, None if not found else F.broadcast(hot) if found <= HOT_LIST else hot)


def entry_rows(key: Column) -> WindowSpec:
    """The rows of an entry, the largest key first; all rows of a bucket are in its owner's task."""
    return W.partitionBy("owner", "bucket", "h", "text").orderBy(key.desc_nulls_last())


def chain_place() -> Column:
    """The place of a text in the chain of its key, in the order of bytes."""
    return F.dense_rank().over(W.partitionBy("owner", "bucket", "h").orderBy("text"))


@dataclass(frozen=True)
class Index:
    """``entries``: bucket, h, chain, text, sha256, keep_id, group_size, on shared files.

    ``found`` has the same of every row, with its id, and without the text.
    """

    entries: DataFrame
    found: DataFrame
    directory: Directory


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_of: Callable[[Column], Column] = text_hash) -> Index:
    """The index of the texts of ``df``. ``hash_of`` can be replaced to test collisions."""
    directory = build_directory(df, text_col, capacity, hash_of)
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("h", hash_of(F.col("text")))
    sha256 = F.sha2(F.col("text").cast("binary"), 256).alias("sha256")

    best = entry_rows(F.col("id"))
    number, size = F.row_number().over(best), F.count(F.lit(1)).over(best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    met = directory.owned(directory.cold(rows)).withColumns({"number": number, "keep_id": F.first("id").over(best), "group_size": size, "chain": chain_place()})
    # the first row of an entry brings its bytes
    cold = materialize(met.select("id", "bucket", "h", "chain", F.when(F.col("number") == 1, F.col("text")).alias("text"), sha256, "keep_id", "group_size"), "index")
    entries, found = cold.where(F.col("text").isNotNull()).drop("id"), cold.drop("text")
    if directory.hot is not None:
        links = directory.of_hot(rows).groupBy("h", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        links = directory.owned(links).withColumn("chain", chain_place())
        links = materialize(links.select("bucket", "h", "chain", "text", sha256, "keep_id", "group_size"), "index")
        asked = directory.find_hot(directory.of_hot(rows), links).select(found.columns)
        entries, found = entries.unionByName(links), found.unionByName(asked)
    return Index(entries, found, directory)


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """``rows``, which have h and text, with chain, sha256, keep_id and group_size of their entry.

    They are joined with the chains of their buckets by key and bytes; those of
    no entry have nulls. Rows of hot keys are not sent anywhere if the entries of
    those are small.
    """
    directory, on = index.directory, ["bucket", "h", "text"]
    found = directory.find(directory.cold(rows)).drop("owner").join(directory.cold(index.entries), on, "left")
    if directory.hot is not None:
        hot = directory.find(directory.of_hot(rows)).drop("owner", "bucket")
        found = found.unionByName(directory.find_hot(hot, directory.of_hot(index.entries), "left"))
    return found.drop("bucket")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_of: Callable[[Column], Column] = text_hash) -> DataFrame:
    """One row for each row: its key, keep_id, group_size, kept, text_sha256."""
    found = build_index(df, id_col, text_col, capacity, hash_of).found
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_of: Callable[[Column], Column] = text_hash) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each text.

    That is the one with the largest id; if rows repeat both, one of them stays.
    """
    directory = build_directory(df, text_col, capacity, hash_of)
    # one column holds the row, so that no name can clash
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    text, key = whole(F.col("row")[text_col]), F.col("row")[id_col]
    rows = rows.withColumn("h", hash_of(text))
    best = entry_rows(key)
    met = directory.owned(directory.cold(rows)).withColumn("text", text)
    kept = met.withColumn("number", F.row_number().over(best)).where("number = 1").select("row")
    if directory.hot is not None:
        hot = directory.of_hot(rows).groupBy("h", text.alias("text")).agg(F.max_by("row", F.struct(key.alias("key"))).alias("row"))
        kept = kept.unionByName(hot.select("row"))
    return kept.select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
