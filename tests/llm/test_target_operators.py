"""Filling in the middle, importance resampling and toxicity against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fim, grams, importance, registry, toxicity

SCHEMA = "doc_id long, text string"
CLASHES = ("fim", "form", "n", "row", "data", "key", "others", "id", "score", "weight", "rank", "place", "range", "label", "words", "stream", "bucket", "count", "key_0")
TEXTS = [None, "", " \n\t", "a", "é" * 3, "é" * 3, "x<P>y", "tail<", "<S", "漢字 und mehr", "🙂🙂", "A-b_c 9Z\x00d", "x" * 300_000, "Word, " * 40_000]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "no key"), (50, "same words here " * 9), (51, "same words here " * 9), (51, "same words here " * 9)]


def table(spark, rows=ROWS, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHES}) if clashes else df


def plain_fim(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return out, "spm" if h[3] % 100 < 20 else "psm", n, a, b - a


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_fim_matches_plain_cuts_and_keeps_columns(spark):
    df = table(spark)
    out = fim.fill_in_middle(df)
    assert out.columns == [*df.columns, "fim_"]
    got = out.select("doc_id", "text", "fim_.form", "fim_.n", "fim_.prefix", "fim_.middle").collect()
    assert in_order(got) == in_order((i, *plain_fim(i, t)) for i, t in ROWS)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert out.where("form = 'other' AND row = 'other' AND others = 'other'").count() == len(ROWS)
    back = out.select("doc_id", fim.restore(F.col("text"), F.col("fim_.form")).alias("text")).collect()
    assert in_order(back) == in_order((i, t or "") for i, t in ROWS)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_fim_of_parts_that_look_like_marks(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("<>PSM<S<P") for _ in range(rng.randint(0, 12)))) for i in range(800)]
    out = fim.fill_in_middle(table(spark, rows, clashes=False), plain_percent=0)
    back = {r["doc_id"]: r["t"] for r in out.select("doc_id", fim.restore(F.col("text"), F.col("fim.form")).alias("t")).collect()}
    assert back == dict(rows)
    assert out.where("fim.form = 'plain'").count() == sum(not t or bool(re.search("<[PSM]>", t)) for _, t in rows)


@pytest.mark.parametrize("units, pattern", [("code_points", r"(?s)."), ("words", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_masks_mark_where_units_begin(units, pattern):
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice("ab é漢🙂\n\t") for _ in range(rng.randint(0, 40)))
        want = [m.start() for m in re.finditer(pattern, text)]
        if units == "words" and text and (not want or want[0] > 0):
            want = [0, *want]  # white space at the start
        want = [len(text[:i].encode()) for i in want]
        data = text.encode()
        bits = fim.UNITS[units](data)
        assert [i for i in range(len(data) + 1) if bits >> i & 1] == want
        assert [fim.select(bits, k, len(data)) for k in range(len(want) + 1)] == [*want, len(data)]


def test_ill_formed_bytes_are_kept(spark):
    df = spark.createDataFrame([(1, b"a\xc3\xff\xe2\x82")], "doc_id long, data binary").select("doc_id", F.col("data").cast("string").alias("text"))
    out = fim.fill_in_middle(df, plain_percent=0).select(F.hex(F.col("text").cast("binary")).alias("h"), "fim.form").first()
    cut = bytes.fromhex(out["h"])
    parts = {m: cut.split(m)[1].split(b"<")[0] for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)}
    assert parts[fim.PREFIX] + parts[fim.MIDDLE] + parts[fim.SUFFIX] == b"a\xc3\xff\xe2\x82"


def plain_words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, percent, least):
    mine = [(i, plain_words(t), plain_buckets(t)) for i, t in rows]
    s, t = Counter(b for _, _, x in mine for b in x), Counter(b for x in target for b in plain_buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, words, x in mine:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("segment", [1 << 16, 7])
def test_runs_have_the_codes_of_their_bytes(segment, monkeypatch):
    monkeypatch.setattr(grams, "SEGMENT", segment)
    rng = random.Random(8)
    for k in range(60):
        texts = ["".join(rng.choice("abcXYZ019 .,-éß漢\x00`{|") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(rng.randint(1, 5))]
        texts += ["x" * 1000 + " b " + "y" * 49 + " z " + "q" * 48] * (k % 10 == 0)
        stream, counts = importance.buckets_of([t.encode() for t in texts])
        assert counts.tolist() == [len(plain_words(t)) for t in texts]
        cuts = np.split(stream, np.cumsum(importance.features_of(counts))[:-1])
        assert [Counter(c.tolist()) for c in cuts] == [Counter(plain_buckets(t)) for t in texts]


def test_resampling_matches_plain_counts(spark):
    target = ["word same words", None, "here word 9z d", "漢字"]
    found = importance.resample(table(spark), table(spark, list(enumerate(target))), percent=60, least_words=3)
    assert in_order(found.collect()) == in_order(plain_resample(ROWS, target, 60, 3))
    empty = table(spark).limit(0)
    assert importance.resample(empty, empty).count() == 0
    assert in_order(importance.resample(table(spark), empty, percent=60, least_words=3).collect()) == in_order(plain_resample(ROWS, [], 60, 3))


def test_resampling_breaks_ties_by_key(spark):
    same = [(7, "a b c"), (7, "a b c"), (7, "a b c")]
    assert sorted(r["rank"] for r in importance.resample(table(spark, same), table(spark), percent=100, least_words=1).collect()) == [1, 2, 3]


def test_merged_runs_count_all():
    rng = np.random.default_rng(3)
    total = np.empty(0, np.uint16), np.empty(0, np.int64)
    parts = [rng.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 500, 0, 30)]
    for part in parts:
        total = importance.merge_runs(total, importance.run_lengths(np.sort(part)))
    assert dict(zip(*map(np.ndarray.tolist, total), strict=True)) == dict(Counter(np.concatenate(parts).tolist()))


def plain_codes(text):
    w = plain_words(text)
    code = lambda *x: zlib.crc32(" ".join(x).encode())
    found = {code(x) for x in w} | {code(*w[i : i + 2]) for i in range(len(w) - 1)}
    for skip, factor in zip(toxicity.SKIPS, toxicity._FACTORS, strict=True):
        found |= {(code(w[i]) * int(factor) & 0xFFFFFFFF) ^ code(w[i + skip + 1]) for i in range(len(w) - skip - 1)}
    return found


@pytest.mark.parametrize("segment", [1 << 16, 5])
def test_toxicity_features_and_scores_match_plain_ones(segment, monkeypatch):
    monkeypatch.setattr(grams, "SEGMENT", segment)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["you", "are", "a", "Fool", "x1", "漢", "ö"]) for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(40)]
    every = sorted(set().union(*map(plain_codes, texts)))
    got = [set() for _ in texts]
    for codes, owners in toxicity.codes_of([t.encode() for t in texts]):
        for c, o in zip(codes.tolist(), owners.tolist(), strict=True):
            got[o].add(c)
    assert got == [plain_codes(t) for t in texts]
    net = toxicity.Weights(np.array(every[::3], np.uint32), np.linspace(-1, 1, len(every[::3])), -0.5)
    weight = dict(zip(every[::3], net.weights.tolist(), strict=True))
    want = [1 / (1 + math.exp(0.5 - sum(weight.get(c, 0) for c in plain_codes(t)))) for t in texts]
    assert np.allclose(net.score([t.encode() for t in texts]), want)


def plain_ftrl(rows, keys):
    """The textbook's update, one coordinate at a time."""
    z, n = dict.fromkeys([*keys, "bias"], 0.0), dict.fromkeys([*keys, "bias"], 0.0)

    def w(k):
        l1 = 0 if k == "bias" else toxicity.L1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((toxicity.DAMPING + math.sqrt(n[k])) / toxicity.RATE + toxicity.L2)

    for at, label, weight in rows:
        mine = {k: w(k) for k in [*at, "bias"]}
        g = (1 / (1 + math.exp(-sum(mine.values()))) - label) * weight
        for k, v in mine.items():
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.RATE * v
            n[k] += g * g
    return {k: w(k) for k in z}


def test_learner_matches_the_textbook(spark):
    rng = random.Random(2)
    rows = [(rng.sample(range(100, 130), 6) + [7] * (i % 3 == 0), int(i % 3 == 0), i) for i in range(300)]
    df = spark.createDataFrame([(label, place, place, sorted(set(codes))) for codes, label, place in rows], "label int, place long, key long, codes array<bigint>")
    got = toxicity.fit(df.repartition(3), {0: 200, 1: 100})
    weigh = {0: 0.75, 1: 1.5}
    epochs = [(set(codes), label, weigh[label]) for codes, label, _ in rows] * toxicity.EPOCHS
    want = plain_ftrl(epochs, [7, *range(100, 130)])
    assert math.isclose(got.bias, want.pop("bias"), abs_tol=1e-9)
    want = {k: v for k, v in want.items() if v}
    assert got.codes.tolist() == sorted(want) and 7 in want
    assert np.allclose(got.weights, [want[k] for k in sorted(want)])


def test_codes_of_few_rows_never_get_a_weight():
    rows = [({"rare", "often"} if i < 2 else {"often"}, 1, 1.0) for i in range(30)] + [(set(), 0, 1.0)] * 30
    assert 2 * toxicity.EPOCHS <= toxicity.L1
    assert plain_ftrl(rows * toxicity.EPOCHS, ["rare", "often"])["rare"] == 0


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, 1, None), (999, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, ROWS + [(i, "you awful fool " * 3 if i % 2 else "kind words to all " * 3) for i in range(20, 40)])
    net = toxicity.train(docs, labels, held=None)
    got = toxicity.with_score(docs, net, ["doc_id", "id"]).collect()
    assert len(got) == len(ROWS) + 20 and all(0 <= r["score"] <= 1 and r["id"] == "other" for r in got)
    one_kind = toxicity.train(docs, labels.where("toxic = 1"), held=None)
    assert {round(r["score"], 4) for r in toxicity.with_score(docs, one_kind, ["doc_id"]).collect()} == {1.0}
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert {round(r["score"], 4) for r in toxicity.with_score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.with_score(docs.limit(0), net, ["doc_id"]).count() == 0


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = registry.queries()["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[scored.toxic == 0]
    order = np.sort(clean.score.to_numpy())
    area = (np.searchsorted(order, toxic.score, "left") + np.searchsorted(order, toxic.score, "right")).mean() / 2 / len(order)
    assert area > 0.95
    assert toxic.predicted.mean() > 0.65 and clean.predicted.mean() < 0.01
