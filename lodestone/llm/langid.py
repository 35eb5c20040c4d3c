"""Language by piece unigrams, with all segmentations summed.

Each language has a probability for each piece of a fixed public byte-level
vocabulary, of any length. The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm; a text scores the product
over its words. Words are lower-cased runs of non-white characters in UTF-8
behind a space, at any length: those of about the same length go together, and
the sum is carried from block to block of a long one, scaled so that it does not
vanish. Each distinct word of a task is scored once and remembered while memory
allows. Languages are scored ``TOGETHER`` at a time, and texts in smaller slices
if there are more, so their number does not bound what can be predicted.

Piece probabilities are fitted by expectation maximisation, whose counts sum
over all segmentations too, on a sample bounded by ``SAMPLE`` rows of each
language, of any length, chosen by a hash: on all words of these, whole whatever
their length. Executors count the words and fit a language each; the driver gets
the pieces that the languages use. Nothing is cut, in the fit or after it.

A null text, an empty one and one without a letter are ``und`` with score 0.
Rows without language are not learned from; without any rows to learn from all
texts are ``und``. Languages that score alike are decided for the first in
order. Equal texts get equal results; an empty table gives no rows. Language,
source and key are never inputs of a prediction; other columns, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, fold, materialize, slices, table

FOLDS, HELD = 3, 1
SAMPLE = 300
#: Words of up to so many bytes are summed over without scaling.
PLAIN = 32
UNKNOWN = "und"
#: Languages scored at a time, bytes of remembered scores, of one group of words, and the positions of a block.
TOGETHER, MEMORY, GROUP, BLOCK = 64, 128 << 20, 16 << 20, 1024
#: Pieces up to this length are found by their bytes as a number, longer ones by their first bytes.
SHORT = 8
#: Positions between two scalings; a probability is far above 1e-300 to the power of their share of it.
SCALING = 16


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def pieces(path: str) -> dict[bytes, int]:
    """The vocabulary's pieces and their numbers; all single bytes are among them."""
    with open(path, "rb") as lines:
        found = [base64.b64decode(line.split()[0]) for line in lines]
    kept = dict.fromkeys([bytes([b]) for b in range(256)] + found)
    return {p: i for i, p in enumerate(kept)}


class Places:
    """Numbers of pieces by their bytes, for whole arrays at once.

    Two hash tables hold a short piece at one of two places; seeds are tried
    until all have one. Long pieces are listed by their first SHORT bytes, which
    a table of flags tells from nearly all others.
    """

    def __init__(self, known: dict[bytes, int]):
        self.count, self.longest = len(known), max(SHORT, *map(len, known))
        short = {p: i for p, i in known.items() if len(p) <= SHORT}
        number = np.fromiter(short.values(), np.int32)
        sizes = np.array([len(p) for p in short], np.uint64)
        keys = np.array([int.from_bytes(p, "little") for p in short], np.uint64)
        self.keys, self.sizes = np.zeros(self.count + 1, np.uint64), np.zeros(self.count + 1, np.uint64)
        self.keys[number], self.sizes[number] = keys, sizes
        seed = 0
        while True:
            seed += 1
            self.factors = np.random.default_rng(seed).integers(0, 1 << 63, 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            self.tables = [np.full(1 << 20, self.count, np.int32) for _ in range(2)]
            left = np.arange(len(number))
            for k in range(2):
                at = self._hash(keys[left], sizes[left], k)
                self.tables[k][at] = number[left]
                left = left[self.tables[k][at] != number[left]]
            if not len(left):
                break
        self.heads: dict[bytes, list[tuple[bytes, int]]] = {}
        for p, i in known.items():
            if len(p) > SHORT:
                self.heads.setdefault(p[:SHORT], []).append((p, i))
        self.flags = np.zeros(1 << 20, bool)
        self.flags[self._hash(np.array([int.from_bytes(h, "little") for h in self.heads], np.uint64), 0, 0)] = True

    def _hash(self, keys: np.ndarray, size: np.ndarray | int, k: int) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(size, np.uint64)) * self.factors[k]) >> np.uint64(44)

    def of(self, keys: np.ndarray, size: int) -> np.ndarray:
        """The piece at each key of ``size`` bytes, or the number of pieces if none is."""
        a = self.tables[0][self._hash(keys, size, 0)]
        b = self.tables[1][self._hash(keys, size, 1)]
        is_a = (self.keys[a] == keys) & (self.sizes[a] == size)
        is_b = (self.keys[b] == keys) & (self.sizes[b] == size)
        return np.where(is_a, a, np.where(is_b, b, self.count))

    def ending(self, found: list[bytes], first: int, last: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, ...]]]:
        """The pieces that end behind ``first`` and up to ``last`` in each word.

        Short ones as an array of ends x lengths x words, long ones as (words,
        lengths, numbers) by their end.
        """
        low = max(0, first - self.longest)
        width = last - low
        data = np.frombuffer(b"".join(w[low:last].ljust(width, b"\0") for w in found), np.uint8).reshape(-1, width).T.astype(np.uint64)
        ids = np.full((last - first, SHORT, len(found)), self.count, np.int32)
        keys = np.zeros_like(data)
        for n in range(1, min(SHORT, width) + 1):
            keys = keys[: width - n + 1] | data[n - 1 :] << np.uint64(8 * (n - 1))
            skip = max(0, first - low - n + 1)  # starts whose pieces end before
            ids[low + skip + n - first - 1 :, n - 1] = self.of(keys[skip:], n)
        long: dict[int, list[tuple[int, int, int]]] = {}
        if width > SHORT:
            for start, w in np.argwhere(self.flags[self._hash(keys, 0, 0)]).tolist():
                start += low
                for piece, i in self.heads.get(found[w][start : start + SHORT], ()):
                    if first < start + len(piece) <= last and found[w].startswith(piece, start):
                        long.setdefault(start + len(piece), []).append((w, len(piece), i))
        return ids, {end: tuple(np.array(x) for x in zip(*found_, strict=True)) for end, found_ in long.items()}


@lru_cache(2)
def places(path: str) -> Places:
    return Places(pieces(path))


def words(text: str) -> list[bytes]:
    return [b" " + w.encode("utf-8", "replace") for w in text.lower().split()]


class Lattice:
    """All segmentations of all words."""

    def __init__(self, found: list[bytes], known: Places):
        self.found, self.known = found, known

    def groups(self, languages: int) -> Iterator[np.ndarray]:
        """Words of about the same length, as many as memory allows."""
        sizes = np.array([len(w) for w in self.found])
        order = np.argsort(sizes, kind="stable")
        first = 0
        while first < len(order):
            least = sizes[order[first]]
            most = GROUP // (8 * languages * (min(int(least), BLOCK) + self.known.longest))
            behind = min(first + max(1, most), int(np.searchsorted(sizes[order], least + least // 8, "right")))
            yield order[first:behind]
            first = behind

    def _score(self, found: list[bytes], prob: np.ndarray) -> np.ndarray:
        sizes, keep = np.array([len(w) for w in found]), self.known.longest
        size, out, logs = int(sizes.max()), np.zeros((len(found), prob.shape[1])), 0.0
        before = np.zeros((keep, len(found), prob.shape[1]))
        before[-1] = 1
        for first in range(0, size, BLOCK):
            last = min(size, first + BLOCK)
            ids, long = self.known.ending(found, first, last)
            alpha = np.concatenate([before, np.zeros((last - first, *before.shape[1:]))])
            for end in range(first + 1, last + 1):
                at = end - first - 1 + keep
                alpha[at] = np.einsum("nbl,nbl->bl", alpha[at - SHORT : at][::-1], prob[ids[end - first - 1]])
                if end in long:
                    w, n, i = long[end]
                    np.add.at(alpha[at], w, alpha[at - n, w] * prob[i])
                done = sizes == end
                if done.any():
                    out[done] = np.log(alpha[at, done]) + (logs[done] if size > PLAIN else 0.0)
                if size > PLAIN and end % SCALING == 0:
                    window = alpha[at - keep + 1 : at + 1]
                    top = window.max(axis=0)
                    window /= top
                    logs = logs + np.log(top)
            before = alpha[-keep:]
        return out

    def score(self, prob: np.ndarray) -> np.ndarray:
        """log probability of each word in each language; ``prob`` is pieces x languages."""
        prob = np.vstack([prob, np.zeros(prob.shape[1])])
        out = np.zeros((len(self.found), prob.shape[1]))
        for members in self.groups(prob.shape[1]):
            out[members] = self._score([self.found[i] for i in members.tolist()], prob)
        return out

    def expected(self, prob: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece of one language; ``weights`` counts the words."""
        prob = np.append(prob, 0.0)
        uses = np.zeros(len(prob))
        if not hasattr(self, "lattices"):
            self.lattices, self.long = [], []
            for members in self.groups(1):
                if len(self.found[members[-1]]) > PLAIN:
                    self.long.append(members)
                    continue
                found = [self.found[i] for i in members.tolist()]
                self.lattices.append((members, np.array([len(w) for w in found]), self.known.ending(found, 0, max(map(len, found)))))
        for members, sizes, (ids, long) in self.lattices:
            alpha = np.zeros((SHORT + len(ids), len(members)))  # SHORT places before the first
            alpha[SHORT - 1] = 1
            for end in range(1, len(ids) + 1):
                at = end + SHORT - 1
                alpha[at] = np.einsum("nb,nb->b", alpha[at - SHORT : at][::-1], prob[ids[end - 1]])
                if end in long:
                    w, n, i = long[end]
                    np.add.at(alpha[at], w, alpha[at - n, w] * prob[i])
            beta = np.zeros_like(alpha)
            for end in range(len(ids), 0, -1):
                at = end + SHORT - 1
                done = sizes == end
                beta[at, done] = weights[members[done]] / alpha[at, done]
                share = prob[ids[end - 1]] * beta[at]
                beta[at - SHORT : at] += share[::-1]
                uses += np.bincount(ids[end - 1].ravel(), (alpha[at - SHORT : at][::-1] * share).ravel(), len(prob))
                if end in long:
                    w, n, i = long[end]
                    share = prob[i] * beta[at, w]
                    np.add.at(beta, (at - n, w), share)
                    np.add.at(uses, i, alpha[at - n, w] * share)
        for members in self.long:
            self._expected(members, prob, weights[members], uses)
        return uses[:-1]

    def _expected(self, members: np.ndarray, prob: np.ndarray, weights: np.ndarray, uses: np.ndarray) -> None:
        """Adds the uses of words of any length, in logarithms; the places of pieces are found block by block, twice."""
        found = [self.found[i] for i in members.tolist()]
        sizes = np.array([len(w) for w in found])
        size, every = int(sizes.max()), np.arange(len(found))
        with np.errstate(divide="ignore"):
            logs = np.log(prob)
        alpha = np.full((SHORT + size + 1, len(found)), -np.inf)  # SHORT places before the first
        alpha[SHORT] = 0
        for first in range(0, size, BLOCK):
            ids, long = self.known.ending(found, first, min(size, first + BLOCK))
            for end in range(first + 1, first + len(ids) + 1):
                at = end + SHORT
                terms = alpha[at - SHORT : at][::-1] + logs[ids[end - first - 1]]
                top = terms.max(axis=0)
                w, n, i = long.get(end, (every[:0],) * 3)
                more = alpha[at - n, w] + logs[i]
                np.maximum.at(top, w, more)
                top = np.where(np.isfinite(top), top, 0.0)
                sums = np.exp(terms - top).sum(axis=0)
                np.add.at(sums, w, np.exp(more - top[w]))
                with np.errstate(divide="ignore"):
                    alpha[at] = top + np.log(sums)
        beta = np.full_like(alpha, -np.inf)
        beta[sizes + SHORT, every] = -alpha[sizes + SHORT, every]
        for first in reversed(range(0, size, BLOCK)):
            ids, long = self.known.ending(found, first, min(size, first + BLOCK))
            for end in range(first + len(ids), first, -1):
                at = end + SHORT
                share = logs[ids[end - first - 1]] + beta[at]
                used = np.exp(alpha[at - SHORT : at][::-1] + share) * weights
                uses += np.bincount(ids[end - first - 1].ravel(), used.ravel(), len(uses))
                beta[at - SHORT : at] = np.logaddexp(beta[at - SHORT : at], share[::-1])
                if end in long:
                    w, n, i = long[end]
                    share = logs[i] + beta[at, w]
                    np.add.at(uses, i, np.exp(alpha[at - n, w] + share) * weights[w])
                    np.logaddexp.at(beta, (at - n, w), share)


@dataclass
class Model:
    """For each language the pieces that it uses, their probabilities, and the scale of all others."""

    languages: list[str]
    used: list[tuple[np.ndarray, np.ndarray, float]]
    path: str

    def prob(self, first: int, behind: int) -> np.ndarray:
        """pieces x languages, for some of the languages."""
        out = np.empty((len(pieces(self.path)), behind - first))
        for column, (number, value, scale) in enumerate(self.used[first:behind]):
            out[:, column] = floor(self.path) / scale
            out[number, column] = value
        return out


@lru_cache(2)
def floor(path: str) -> np.ndarray:
    """Every piece keeps a little probability, single bytes more of it."""
    return np.where(np.array([len(p) for p in pieces(path)]) == 1, 0.5, 0.02)


def fit_language(found: list[bytes], counts: np.ndarray, path: str, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """EM from a start that favours long pieces: (pieces that are used, their probabilities, scale of the others)."""
    sizes = np.array([len(p) for p in pieces(path)], float)
    lattice = Lattice(found, places(path))
    prob = np.exp(-12.0 / sizes)
    prob /= prob.sum()
    for _ in range(rounds):
        uses = lattice.expected(prob, counts) + floor(path)
        prob = uses / uses.sum()
    number = np.flatnonzero(uses > floor(path) * (1 + 1e-6)).astype(np.int32)
    return number, prob[number], float(uses.sum())


def fit(samples: dict[str, Counter], path: str) -> Model:
    """The model of given counts of words by language."""
    used = []
    for language in sorted(samples):
        kept = sorted(samples[language].items())
        used.append(fit_language([w for w, _ in kept], np.array([n for _, n in kept], float), path))
    return Model(sorted(samples), used, path)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held: int | None) -> DataFrame:
    """lang, word, n: the words of at most SAMPLE rows of each language.

    Rows are chosen by a hash of key and text, which alone are ranked; then
    their texts are fetched and executors count the words.
    """
    rows = docs.where(F.col(lang_col).isNotNull())
    if held is not None:
        rows = rows.where(fold(id_col, FOLDS) != held)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").withColumn("r", rank).where(F.col("r") <= SAMPLE).select("lang", "h").distinct()
    chosen = materialize(chosen, "sample")
    texts = rows.join(broadcast_if_small(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.update((lang, w) for w in words(text or ""))
                keys = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Predictor:
    """Scores texts; remembers the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, places(model.path)
        self.blocks = range(0, len(model.languages), TOGETHER)
        self.prob = model.prob(0, len(model.languages)) if len(self.blocks) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.scores = np.zeros((1 << 12, len(self.model.languages)))

    @property
    def slice_bytes(self) -> int:
        """Text bytes to predict at once."""
        return max(1 << 12, (1 << 20) * TOGETHER // max(TOGETHER, len(self.model.languages)))

    def _learn(self, fresh: list[bytes]) -> None:
        base = len(self.number)
        while base + len(fresh) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        lattice = Lattice(fresh, self.known)
        for first in self.blocks if fresh else ():
            behind = min(first + TOGETHER, len(self.model.languages))
            prob = self.model.prob(first, behind) if self.prob is None else self.prob
            self.scores[base : base + len(fresh), first:behind] = lattice.score(prob)
        self.number.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.bytes += sum(map(len, fresh))

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        tags, scores = [], []
        if self.bytes + self.scores.nbytes > MEMORY:
            self._forget()
        split = [words(t) if t else [] for t in texts]
        self._learn(list(dict.fromkeys(w for ws in split for w in ws if w not in self.number)) if self.model.languages else [])
        for t, ws in zip(texts, split, strict=True):
            if not self.model.languages or not ws or not any(map(str.isalpha, t)):
                tags.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(total.argmax())
            tags.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return tags, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int | None = HELD, path: str | None = None) -> Model:
    path = path or vocabulary()

    def of_language(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        number, value, scale = fit_language(rows["word"].to_pylist(), rows["n"].to_numpy().astype(float), path)
        return pa.table({"lang": rows["lang"].slice(0, 1), "number": pa.array([number.tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary()), "scale": [scale]})

    fitted = sample(docs, id_col, text_col, lang_col, held).groupBy("lang").applyInArrow(of_language, "lang string, number binary, value binary, scale double")
    rows = sorted(fitted.collect(), key=lambda r: r["lang"])  # a row of each language: 12 bytes of each piece that it uses
    return Model([r["lang"] for r in rows], [(np.frombuffer(r["number"], np.int32), np.frombuffer(r["value"]), r["scale"]) for r in rows], path)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score``, the probability of the language given the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the pieces that each language's sample uses
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            for part in slices(batch, 1, predictor.slice_bytes):
                tags, scores = predictor.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tags, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the held-out fold is not learned from."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
