"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct 32-bit codes of its words, of its pairs of
neighbouring words, and of its pairs with one or two words left out between
them. Each is 1 if it occurs anywhere in the text, so length does not dilute it.
The learner goes through a sample in an order by hash; each coordinate has its
own rate by the gradients that it has seen, and L1 regularisation holds weights
at exactly 0 until their gradients add up to more than ``L1``. What is left is a
few thousand codes and weights, which are broadcast.

The sample is bounded by ``SAMPLE`` rows of each label, whole texts whatever
their length, and both labels weigh the same in it. Tasks cut its texts into
codes. A code whose rows' weights, times ``EPOCHS``, don't exceed ``L1`` could
never leave the weight 0 and is left out first, which changes no result. The rest
are fitted row by row in one task that streams through the sample's file for each
epoch; only the coordinates' sums come back.

A null text counts as empty; a text without words has the score of the bias.
Equal texts get equal scores. Labels, language, source and key are never inputs
of a score. A key without a row or a row without a label does not matter;
contradicting labels of a key are both used. Without labels of both kinds every
score is the share of toxic labels, 0 if there are none. Empty tables give no
rows. Texts are read in segments of words, so memory follows from the longest
text. Other columns are neither read nor returned by :func:`with_score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import fold, materialize, release, slices, table, whole

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
#: Labelled rows of each label to learn from, at most.
SAMPLE = 4000
EPOCHS, RATE, DAMPING, L1, L2 = 5, 2.0, 1.0, 10.0, 0.0
#: Words left out of skip-grams.
SKIPS = (1, 2)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def codes_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text of each) of all features, for segments of the words; a code may repeat."""
    found = grams.words(texts)
    text = np.repeat(np.arange(len(texts)), found.counts())
    left = found.first[1:][text] - np.arange(len(text))  # words from each to its text's end
    ahead = max(SKIPS) + 1
    carried = np.empty(0, np.uint32)  # codes of the words of later segments that pairs reach
    for low in range(0, len(text), grams.SEGMENT):
        high = min(low + grams.SEGMENT, len(text))
        until = min(high + ahead, len(text))
        start = low + len(carried)
        fresh = grams.advance(found.data, found.starts[start:until], found.lengths[start:until], np.full(until - start, grams.NONE)) ^ grams.NONE
        one = np.concatenate([carried, fresh])
        carried = one[high - low :]
        rest, owner = left[low:high], text[low:high]
        n = min(high, len(text) - 1) - low
        pairs = grams.advance(found.data, found.starts[low + 1 : low + 1 + n] - 1, found.lengths[low + 1 : low + 1 + n] + 1, one[:n] ^ grams.NONE) ^ grams.NONE
        inside = rest[:n] > 1
        codes, owners = [one[: high - low], pairs[inside]], [owner, owner[:n][inside]]
        for skip, factor in zip(SKIPS, _FACTORS, strict=True):
            inside = np.flatnonzero(rest > skip + 1)
            codes.append((one[inside] * factor) ^ one[inside + skip + 1])
            owners.append(owner[inside])
        yield np.concatenate(codes), np.concatenate(owners)


@dataclass
class Weights:
    """Codes in order, a weight for each, and the bias."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    near: np.ndarray = field(init=False)  # the last 16 bits of codes that have a weight

    def __post_init__(self) -> None:
        self.near = np.zeros(1 << 16, bool)
        self.near[self.codes & np.uint32(0xFFFF)] = True

    def score(self, texts: list[bytes]) -> np.ndarray:
        hits = [np.empty(0, np.int64)]
        for codes, owners in codes_of(texts) if len(self.codes) else ():
            maybe = np.flatnonzero(self.near[codes & np.uint32(0xFFFF)])
            codes, owners = codes[maybe], owners[maybe]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            same = self.codes[at] == codes
            hits.append(np.unique(owners[same] * len(self.codes) + at[same]))
        owner, at = np.divmod(np.unique(np.concatenate(hits)), max(1, len(self.codes)))  # a feature counts once for a text
        total = self.bias + np.bincount(owner, self.weights[at] if len(at) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Learner:
    """The sums of FTRL-proximal: ``z`` of gradients, ``n`` of their squares; the last coordinate is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray) -> None:
        self.z, self.n = z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)  # the bias is free
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((DAMPING + np.sqrt(n)) / RATE + L2))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[at] = n + g * g


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held: int | None) -> DataFrame:
    """label, place, key, codes (distinct, in order) of at most SAMPLE rows of each label that have a document, by a hash of the key.

    ``place`` is another hash, so that the labels' rows mix in its order.
    ``held`` is the remainder of the fold that is left out, if any.
    """
    rows = labels.select(F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    if held is not None:
        rows = rows.where(fold("key", FOLDS) != held)
    known = docs.select(F.col(id_col).alias("key"), whole(text_col).cast("binary").alias("data"))
    order = [F.xxhash64(F.lit("toxic"), "key"), "key"]
    with_text = rows.join(known.select("key"), "key", "left_semi")
    parts = [with_text.where(F.col("label") == k).orderBy(*order).limit(SAMPLE) for k in (0, 1)]
    chosen = materialize(parts[0].unionByName(parts[1]).distinct(), "sample")
    found = known.join(F.broadcast(chosen), "key").select("label", F.xxhash64(F.lit("place"), "key").alias("place"), "key", "data")  # 2 * SAMPLE keys at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 3)):
            texts = part.column(3).to_pylist()
            mine = [np.empty(0, np.uint64)]
            for codes, owners in codes_of(texts):
                mine.append(np.unique(owners.astype(np.uint64) << np.uint64(32) | codes))
            every = np.unique(np.concatenate(mine))
            ends = np.searchsorted(every >> np.uint64(32), np.arange(len(texts) + 1))
            codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((every & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], codes], ["label", "place", "key", "codes"])

    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(run, f"label int, place bigint, key {kind}, codes array<bigint>")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's numbers as the bytes of one row."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())], ["codes"])


def fit(rows: DataFrame, counts: dict[int, int]) -> Weights:
    """The weights after EPOCHS passes over ``rows`` (label, place, key, codes), ``counts`` of each label, in the order of place and key."""
    spark = rows.sparkSession
    weigh = {label: sum(counts.values()) / 2 / n for label, n in counts.items()}
    seen = rows.select(F.explode("codes").alias("code"), F.when(F.col("label") == 1, weigh[1]).otherwise(weigh[0]).alias("weight"))
    listed = materialize(seen.groupBy("code").agg(F.sum("weight").alias("weight")).where(F.col("weight") * EPOCHS > L1).select("code"), "codes")
    packed = listed.mapInArrow(pack, "codes binary").collect()  # eight bytes for each code of the bounded sample
    known = np.sort(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["codes"], np.int64) for r in packed)]))
    release(listed)
    shared = spark.sparkContext.broadcast(known)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.append(shared.value, -1)
        for batch in batches:
            codes = batch.column(1)
            for i in range(batch.num_rows):
                mine = codes[i].values.to_numpy()
                at = np.searchsorted(shared.value, mine)
                at = np.append(at[padded[at] == mine], len(shared.value)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([at.tobytes()], pa.binary())], ["label", "at"])

    ordered = rows.coalesce(1).sortWithinPartitions("place", "key", "label", F.hash("codes")).select("label", "codes")
    ordered = materialize(ordered.mapInArrow(number, "label int, at binary"), "ordered")
    z = n = np.zeros(len(known) + 1)
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            learner = Learner(*(x.copy() for x in state.value))
            for batch in batches:
                for label, at in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    learner.learn(np.frombuffer(at.as_buffer(), np.int32), label, weigh[label])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (learner.z, learner.n)], ["z", "n"])

        (row,) = ordered.coalesce(1).mapInArrow(run, "z binary, n binary").collect()
        z, n = (np.frombuffer(x, np.float64) for x in row)
        state.destroy()
    release(ordered)
    learnt = Learner(z, n).weights(np.arange(len(z)))
    kept = np.flatnonzero(learnt[:-1])
    return Weights(known[kept].astype(np.uint32), learnt[:-1][kept], float(learnt[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int | None = HELD) -> Weights:
    rows = materialize(sample(docs, labels, id_col, text_col, held), "grams")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(counts) == 2:
        return fit(rows, counts)
    share = min(max(float(sum(counts)), 1e-6), 1 - 1e-6)  # the one label there is
    return Weights(np.empty(0, np.uint32), np.empty(0), float(np.log(share / (1 - share))))


def with_score(df: DataFrame, weights: Weights, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``score`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # the sample's codes of weight
    rows = df.select(*(F.col(c).alias(f"key_{i}") for i, c in enumerate(id_cols)), whole(text_col).cast("binary").alias("data"))
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, n)):
            score = shared.value.score(part.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(score, pa.float64())], [*part.schema.names[:n], "score"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    scored = rows.mapInArrow(run, fields + "score double")
    return scored.select(*(F.col(f"key_{i}").alias(c) for i, c in enumerate(id_cols)), "score")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; the held-out fold is not learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
