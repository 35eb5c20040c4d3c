"""Document quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Learned filters see WIDTH bytes from every byte of
it; the last ones see zeros behind its end. Chunks of CHUNK such windows overlap
by half and cover the whole text. Each filter is rectified and max-pooled over
each chunk, and the mean and the maximum over all chunks are combined into one
probability. Long texts are read in segments, whose chunks add up, so memory
does not grow with a text beyond its own bytes.

The network is fitted on the driver to a sample of labelled rows that is
bounded by ``SAMPLE`` rows of each label, to their whole texts in the same
segments; of each chunk only what its maxima saw is kept for the gradient. All
counts, and every score, cover all rows and whole texts. Fitting is seeded and
does not depend on the order of rows.

A null text counts as empty; an empty text has the features 0 and gets a score
like any other. Equal texts get equal scores. Labels, language, source and key
are never inputs of a score. A key without a row or a row without a label does
not matter; contradicting labels of a key are both used. Without labels of both
kinds every score is the share of good labels, 0.5 if there are none. Empty
tables give no rows. Other columns, whatever their names, are returned as they
came by :func:`keep_good`, else neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, materialize, slices, table, whole

WIDTH, FILTERS, CHUNK = 6, 12, 512
HALF = CHUNK // 2
SAMPLE = 1200
FOLDS, THRESHOLD = 5, 0.3
#: Halves of chunks in a segment, and window starts that are scored together.
SEGMENT, TOGETHER = 512, 1 << 18


def segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, window starts) of runs of whole chunks; each chunk is in one run."""
    halves = max(1, -(-len(text) // HALF))
    for first in range(0, max(1, halves - 1), SEGMENT):
        at = first * HALF
        starts = min(len(text) - at, (SEGMENT + 1) * HALF)
        yield text[at : at + starts + WIDTH - 1], starts


@dataclass
class Network:
    """Filters by place, byte and number; the weights of pooled features."""

    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # of the chunks' mean
    top: np.ndarray  # of the chunks' maximum
    base: float

    def windows(self, parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, the filters' values from each byte, first byte and number of halves of each part).

        Windows from beyond the starts of a part have no value.
        """
        starts = np.array([n for _, n in parts], np.int64)
        data = np.frombuffer(b"".join(t.ljust(n + WIDTH - 1, b"\0") for t, n in parts) + bytes(WIDTH), np.uint8)
        begin = np.cumsum(starts + WIDTH - 1) - (starts + WIDTH - 1)
        n = len(data) - WIDTH
        out = self.filters[0].take(data[:n], axis=0)
        for k in range(1, WIDTH):
            out += self.filters[k].take(data[k : n + k], axis=0)
        out += self.bias
        behind = (begin + starts)[:, None] + np.arange(WIDTH - 1)
        out[behind.ravel()] = -1e9
        return data, out, begin, np.maximum(1, -(-starts // HALF))

    def chunks(self, parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
        """(values of chunks, part of each, first byte of each half, first half of each chunk, whether it has a second, windows, bytes)."""
        data, out, begin, halves = self.windows(parts)
        part = np.repeat(np.arange(len(parts)), halves)
        number = np.arange(len(part)) - np.repeat(np.cumsum(halves) - halves, halves)
        at = begin[part] + number * HALF
        half = np.maximum.reduceat(out, at, axis=0)
        two = number + 1 < halves[part]
        first = np.flatnonzero(two | (halves[part] == 1))
        two = two[first]
        value = np.where(two[:, None], np.maximum(half[first], half[np.minimum(first + 1, len(half) - 1)]), half[first])
        return np.maximum(value, 0), part[first], at, first, two, out, data

    def maxima(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values of chunks, text of each, the WIDTH bytes at each chunk's maxima), of about TOGETHER windows at a time."""
        values, owners, seen = [], [], []
        waiting: list[tuple[bytes, int]] = []
        mine: list[int] = []

        def settle() -> None:
            value, part, at, first, two, out, data = self.chunks(waiting)
            last = np.append(at, len(out))
            best = np.empty(value.shape, np.int64)
            for c, (h, pair) in enumerate(zip(first.tolist(), two.tolist(), strict=True)):
                best[c] = last[h] + out[last[h] : last[h + 1 + pair]].argmax(axis=0)
            values.append(value)
            owners.append(np.array(mine)[part])
            seen.append(data[best[..., None] + np.arange(WIDTH)])
            waiting.clear()
            mine.clear()

        for i, text in enumerate(texts):
            for part in segments(text):
                waiting.append(part)
                mine.append(i)
                if sum(n for _, n in waiting) >= TOGETHER:
                    settle()
        if waiting:
            settle()
        return np.concatenate(values), np.concatenate(owners), np.concatenate(seen)

    def combine(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(mean @ self.mean + top @ self.top + self.base, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each text; parts of about TOGETHER windows are in memory at a time."""
        total, top, count = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        waiting: list[tuple[bytes, int]] = []
        owners: list[int] = []

        def settle() -> None:
            value, part, *_ = self.chunks(waiting)
            owner = np.array(owners)[part]
            np.add.at(total, owner, value)
            np.maximum.at(top, owner, value)
            np.add.at(count, owner, 1)
            waiting.clear()
            owners.clear()

        held = 0
        for i, text in enumerate(texts):
            for part in segments(text) if text else ():
                waiting.append(part)
                owners.append(i)
                held += part[1]
                if held >= TOGETHER:
                    settle()
                    held = 0
        if waiting:
            settle()
        return self.combine(total / np.maximum(count, 1)[:, None], top)


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS), np.zeros(FILTERS), float(np.log(share / (1 - share))))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the weighted log loss; only the windows at a chunk's maxima have gradients."""
    rng = np.random.default_rng(seed)
    net = constant(float((labels * weights).sum() / weights.sum()))
    net.filters = (rng.standard_normal(net.filters.shape) * 0.15).astype(np.float32)
    net.bias += 0.1
    net.mean, net.top = rng.standard_normal(FILTERS) * 0.3, rng.standard_normal(FILTERS) * 0.3
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.filters, net.bias, net.mean, net.top)]
    t, base = 0, [0.0, 0.0]
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            value, owner, seen = net.maxima([texts[j] for j in pick])
            count = np.bincount(owner, minlength=len(pick))
            head = np.cumsum(count) - count
            mean, top = np.add.reduceat(value, head, axis=0) / count[:, None], np.maximum.reduceat(value, head, axis=0)
            d = (net.combine(mean, top) - labels[pick]) * weights[pick] / len(pick)
            # through the mean of all chunks, and the maximum of one chunk
            g = (d / count)[owner, None] * net.mean + (value == top[owner]) * (d[owner, None] * net.top)
            g *= value > 0
            grads = [np.zeros_like(net.filters), g.sum(axis=0), mean.T @ d + 1e-4 * net.mean, top.T @ d + 1e-4 * net.top]
            f = np.broadcast_to(np.arange(FILTERS), value.shape)
            for k in range(WIDTH):
                np.add.at(grads[0][k], (seen[..., k], f), g)
            t += 1
            step = rate * min(1, 2 * (1 - epoch / epochs))
            for p_, g_, (m, v) in zip((net.filters, net.bias, net.mean, net.top), grads, state, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.01 * (g_ * g_ - v)
                p_ -= (step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(p_.dtype)
            base = [0.9 * base[0] + 0.1 * d.sum(), 0.99 * base[1] + 0.01 * d.sum() ** 2]
            net.base -= step * (base[0] / (1 - 0.9**t)) / (base[1] ** 0.5 / (1 - 0.99**t) ** 0.5 + 1e-7)
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held: int | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, labels, weights): at most SAMPLE rows of each label that have a document, by a hash of the key.

    The weights give each label its share among all labelled rows. ``held`` is
    the remainder of the fold that is left out, if any.
    """
    rows = labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    if held is not None:
        rows = rows.where(fold("key", FOLDS) != held)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    known = docs.select(F.col(id_col).alias("key"), whole(text_col).cast("binary").alias("data"))
    order = [F.xxhash64("key"), "key"]
    with_text = rows.join(known.select("key"), "key", "left_semi")
    parts = [with_text.where(F.col("label") == k).orderBy(*order).limit(SAMPLE) for k in (0, 1)]
    chosen = materialize(parts[0].unionByName(parts[1]).distinct(), "sample")
    found = known.join(F.broadcast(chosen), "key").select("key", "label", "data")  # 2 * SAMPLE keys at most
    parts = [found.where(F.col("label") == k).orderBy(*order, "data").limit(SAMPLE) for k in (0, 1)]
    got = [(bytes(r["data"]), r["label"]) for p in parts for r in p.collect()]
    y = np.array([label for _, label in got], float)
    total = max(1, sum(counts.values()))
    share = np.array([counts.get(int(label), 0) / total / max(1, (y == label).sum()) for label in y])
    return [t for t, _ in got], y, share * len(y)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int | None = 0) -> Network:
    texts, y, weights = sample(docs, labels, id_col, text_col, held)
    if len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    return fit(texts, y, weights)


def with_score(df: DataFrame, net: Network, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``score`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few hundred kilobytes
    rows = df.select(*(F.col(c).alias(f"key_{i}") for i, c in enumerate(id_cols)), whole(text_col).cast("binary").alias("data"))
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n):
                score = shared.value.score(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(score, pa.float64())], [*part.schema.names[:n], "score"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    scored = rows.mapInArrow(run, fields + "score double")
    return scored.select(*(F.col(f"key_{i}").alias(c) for i, c in enumerate(id_cols)), "score")


def keep_good(df: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``, as they came."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    # one column holds the row, so that any name will do
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            for part in slices(pa.RecordBatch.from_arrays([row, row.field(at)], ["row", "text"]), 1):
                kept = shared.value.score([(t or "").encode() for t in part.column(1).to_pylist()]) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(kept))], ["row"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]])).select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; the held-out fold is not learned from."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, net, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
