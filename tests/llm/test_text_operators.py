"""Secrets, quality, licences, language and media against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import automaton, langid, licenses, media, quality, registry, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é" * 3), (5, "é" * 3), (None, "token = abcdef12"), (7, "x" * 200_000), (8, "word " * 30_000)]


def edge_rows(spark):
    # extra columns whose names the operators use themselves
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in EDGES], SCHEMA)
    return df.withColumns({c: F.lit("other") for c in ("id", "data", "score", "kind", "spans", "h", "key", "key_0", "_data", "word", "row", "dir", "label", "license", "media")})


def plain_spans(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_match_regular_expressions():
    scanner, rng = secrets.scanner(), random.Random(3)
    parts = ["token", "Token", "=", ":", " ", '"', "'", "abcdef12", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP1234", "é", "x", "pass", "word", "api_key", "apikey", "secret", "\n", "AKIA12", "xoxb-", "."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        mine = sorted((s, secrets.BASE.index(k), e) for k, s, e in scanner.spans(text.encode()) if k in secrets.BASE)
        assert mine == plain_spans(text), text


def test_a_dropped_match_still_covers_its_text():
    assert secrets.scanner().spans(b"token=token:abcdef12") == []
    assert secrets.scanner().spans(b"token=abcdef") == [("assign", 0, 12)]


def test_automaton_agrees_with_re():
    rng = random.Random(5)
    for pattern in ["ab|cd*", "(a|bc){2,3}", "[^ab]c+", r"a\x62?", "a{2}b*", "(ab|a)(c|bcd)"]:
        dfa = automaton.build([automaton.parse(pattern)], search=False)
        for _ in range(400):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
            state = dfa.start
            for b in text.encode():
                state = dfa.next[state + b]
            assert (state >= dfa.accepting) == bool(re.fullmatch(pattern, text)), (pattern, text)


@pytest.mark.parametrize("name", ["secrets", "quality", "language", "media", "licenses"])
def test_edge_rows(spark, name):
    df = edge_rows(spark)
    net = quality.fit([b"good text here", b"&&& $$$"], np.array([1.0, 0.0]), np.ones(2), epochs=1)
    model = langid.fit({"en": langid.Counter(langid.words("the word is here")), "de": langid.Counter(langid.words("das wort ist da"))}, langid.vocabulary())
    made = {
        "secrets": lambda d: secrets.find_secrets(d),
        "quality": lambda d: quality.with_score(d, net, ["doc_id"]),
        "language": lambda d: langid.identify(d, model),
        "media": lambda d: media.media_column(d),
        "licenses": lambda d: licenses.scan_licenses(d.withColumn("path", F.lit("/a//b.txt"))),
    }[name]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = made(df).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(rows) == len(EDGES)
    twice = [tuple(r) for r in rows if r["doc_id"] == 5]
    assert twice[0] == twice[1]
    assert made(df.limit(0)).collect() == []


def test_language_of_texts_without_letters(spark):
    model = langid.fit({"en": langid.Counter([b" the"])}, langid.vocabulary())
    tags, scores = langid.Predictor(model).batch([None, "", "12 !!", "the"])
    assert tags == ["und", "und", "und", "en"] and scores[:3] == [0, 0, 0]
    assert langid.Predictor(langid.fit({}, langid.vocabulary())).batch(["the"]) == (["und"], [0.0])


def test_forward_sums_all_segmentations():
    known = langid.pieces(langid.vocabulary())
    rng = np.random.default_rng(1)
    prob = rng.random((len(known), 2))
    prob /= prob.sum(axis=0)

    def plain(word):
        if not word:
            return np.ones(2)
        return sum((prob[known[word[:n]]] * plain(word[n:]) for n in range(1, len(word) + 1) if word[:n] in known), np.zeros(2))

    found = [b" the", b" a", "é".encode(), b" nation"]
    assert np.allclose(langid.Lattice(found, langid.places(langid.vocabulary())).score(prob), [np.log(plain(w)) for w in found])

    def plain_log(word):
        """The same sum from the left, in exact fractions of powers of two."""
        mantissa, power = [np.ones(2)], [0]
        for e in range(1, len(word) + 1):
            top = max(power[max(0, e - 33) : e])
            x = sum((prob[known[word[s:e]]] * mantissa[s] * 2.0 ** (power[s] - top) for s in range(max(0, e - 33), e) if word[s:e] in known), np.zeros(2))
            shift = int(np.floor(np.log2(x.max())))
            mantissa.append(x * 2.0**-shift)
            power.append(top + shift)
        return np.log(mantissa[-1]) + power[-1] * np.log(2)

    # whole words without spaces, long pieces, blocks and scaling; groups of unlike lengths
    long = [" 語言識別不需要空格".encode() * 7 + b"!" * 11, b" " + b"governmentinternationalresponsibility" * 90, b" " + bytes(rng.integers(1, 256, 2500).astype(np.uint8)), b"x" * 33, b" " * 40, b"\0" * 35]
    assert len(long[0]) > 200 and any(len(p) > 8 and p in long[1] for p in known)
    many = [*found, *long, *(long[1][i : i + n] for i, n in zip(range(60), rng.integers(1, 300, 60), strict=True))]
    assert np.allclose(langid.Lattice(many, langid.places(langid.vocabulary())).score(prob), [plain_log(w) for w in many], rtol=1e-10)
    # expected uses weigh each segmentation by its probability: bytes are covered once
    found += [" international".encode(), b" " * 20]
    uses = langid.Lattice(found, langid.places(langid.vocabulary())).expected(prob[:, 0], np.ones(len(found)))
    assert np.isclose((uses * [len(p) for p in known]).sum(), sum(map(len, found)))


def test_expected_uses_of_long_words(monkeypatch):
    known = langid.pieces(langid.vocabulary())
    rng = np.random.default_rng(2)
    prob = rng.random(len(known))
    prob /= prob.sum()
    size = np.array([len(p) for p in known])
    found = [" international".encode(), b" governmentinternationalresponsibility" * 3, " 語言識別不需要空格".encode() * 2, b"a" * 31, b" tooth"]
    weights = np.array([1.0, 2, 3, 1, 5])
    uses = []
    for plain in (1 << 20, 0):  # all words by plain sums, all by logarithms
        monkeypatch.setattr(langid, "PLAIN", plain)
        monkeypatch.setattr(langid, "BLOCK", 16 if not plain else 1024)
        uses.append(langid.Lattice(found, langid.places(langid.vocabulary())).expected(prob, weights))
    assert np.allclose(*uses) and (uses[0][size > 8] > 0).any()
    # far beyond what plain sums can hold
    long = [" 語言識別不需要空格".encode() * 90, bytes(rng.integers(1, 256, 3000).astype(np.uint8))]
    uses = langid.Lattice(long, langid.places(langid.vocabulary())).expected(prob, np.array([1.0, 1.0]))
    assert np.isclose((uses * size).sum(), sum(map(len, long)))


def test_any_number_of_languages_is_predicted(spark):
    # a language each of its own letters, more than are scored together, and words beyond the sample's parts
    tags = {f"l{i:03}": "".join(chr(0x4E00 + 50 * i + j) for j in range(50)) for i in range(langid.TOGETHER + 9)}
    df = spark.createDataFrame([(i, v + " " + v[:20] * 20, k) for i, (k, v) in enumerate(tags.items())], "doc_id long, text string, lang string")
    model = langid.train(df, held=None)
    assert model.languages == sorted(tags)
    got = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def held_out(spark, rows, right):
    return rows.where("held_out").agg(F.avg(right.cast("double"))).first()[0]


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.queries()["op7_language"](spark, sf)
    true = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    assert held_out(spark, found.join(true, "doc_id"), F.col("lang") == F.col("lang_pred")) > 0.97
    ids = {r[0]: r[1] for r in found.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in ids.items())


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.queries()["op3_quality"](spark, sf)
    true = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    assert held_out(spark, found.join(true, "doc_id"), F.col("quality") == F.col("predicted")) > 0.9
    rows = found.join(true, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98  # area under the curve


def plain_score(net, text):
    """Window by window, chunk by chunk."""
    window = lambda i: np.maximum(0, sum((net.filters[k, text[i + k] if i + k < len(text) else 0] for k in range(quality.WIDTH)), net.bias.astype(float)))
    chunks = [range(i, min(i + quality.CHUNK, len(text))) for i in range(0, max(1, len(text) - quality.HALF), quality.HALF)]
    best = np.array([np.max([window(i) for i in chunk], axis=0) for chunk in chunks]) if text else np.zeros((1, quality.FILTERS))
    return 1 / (1 + np.exp(-(best.mean(axis=0) @ net.mean + best.max(axis=0) @ net.top + net.base)))


def test_quality_scores_match_a_plain_network(monkeypatch):
    rng = random.Random(9)
    texts = [b"", b"a", b"ab", b"\0" * 40, b"the cat " * 300, b"&&& " * 7, "é".encode() * 555]
    texts += [bytes(rng.choices(range(256), k=n)) for n in (255, 256, 257, 511, 512, 513, 768, 769, 1024, 1025, 3000)]
    net = quality.fit(texts, np.arange(len(texts)) % 2.0, np.ones(len(texts)), epochs=2)
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-5)
    assert np.allclose(net.score(texts[::-1])[::-1], want, atol=1e-5)
    assert np.allclose([net.score([t])[0] for t in texts], net.score(texts), atol=1e-12)
    monkeypatch.setattr(quality, "SEGMENT", 2)
    monkeypatch.setattr(quality, "TOGETHER", 600)
    assert np.allclose(net.score(texts), want, atol=1e-5)


def test_quality_learns_from_long_texts(spark):
    rows = [(i, ("good words here " if i % 2 else "zz&&## ") * (1 + 3000 * (i % 3 == 0)), i % 2) for i in range(120)]
    rows += [(1000, "x", 7), (1001, "only a label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").unionByName(spark.range(5000, 9000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    texts, y, _ = quality.sample(df, labels, "doc_id", "text", None)
    assert len(texts) == 120 and y.sum() == 60
    assert {len(t) for t in texts} == {7, 16, 7 * 3001, 16 * 3001}  # whole


def test_quality_maxima_by_segments(monkeypatch):
    rng = np.random.default_rng(4)
    net = quality.constant(0.5)
    net.filters = rng.standard_normal(net.filters.shape).astype(np.float32)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 3, 511, 512, 5000, 20_000)]
    whole = net.maxima(texts)
    monkeypatch.setattr(quality, "SEGMENT", 3)
    monkeypatch.setattr(quality, "TOGETHER", 2000)
    for a, b in zip(whole, net.maxima(texts), strict=True):
        assert np.array_equal(a, b)
    value, owner, seen = whole
    assert value.shape[0] == sum(max(1, -(-len(t) // quality.HALF) - 1) for t in texts)
    at = np.arange(quality.WIDTH)
    again = np.maximum(net.filters[at[:, None, None], seen.transpose(2, 0, 1), np.arange(quality.FILTERS)].sum(0) + net.bias, 0)
    assert np.allclose(again[owner > 0], value[owner > 0], atol=1e-4)


@pytest.mark.parametrize("slab", [media.SLAB, 3])
def test_media_round_trip(slab, monkeypatch):
    monkeypatch.setattr(media, "SLAB", slab)
    rng = random.Random(2)
    texts = [b"", b"a", bytes([128]) * 200, bytes(range(256)) * 3, b"\0" * 64, "’“–é".encode() * 100, b"\xff" * 640]
    texts += [rng.randbytes(rng.randint(0, 700)) for _ in range(60)]
    for text, (n, file, payload, what) in zip(texts, media.store(texts), strict=True):
        assert (n, payload) == (len(text), media.padded(text))
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert next(media.store([text]))[1:] == (file, payload, what)
        width, height, pixels = media.read_jpeg(file)
        assert pixels.shape == (height // 8, width // 8) and what.startswith(f"{width}x{height}:")
        blocks = np.frombuffer(payload, np.uint8)[::64]
        assert (pixels.ravel()[: len(blocks)] == blocks).all()


def plain_decode(frame):
    """One bit at a time, for a scan of one component."""
    bits = "".join(f"{b:08b}" for b in re.sub(rb"\xff[\xd0-\xd7]", b"\xff", frame.data.replace(b"\xff\x00", b"\xff\x01")).replace(b"\xff\x01", b"\xff")) if not frame.restart else None
    assert bits is not None
    codes = {}
    for kind, (counts, symbols) in frame.tables.items():
        code, at, codes[kind] = 0, 0, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                codes[kind][f"{code:0{n}b}"] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
    place = 0

    def symbol(kind):
        nonlocal place
        for n in range(1, 17):
            if bits[place : place + n] in codes[kind]:
                place += n
                return codes[kind][bits[place - n : place]]
        raise AssertionError

    def value(size):
        nonlocal place
        v = int(bits[place : place + size] or "0", 2)
        place += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    across, down, _ = frame.blocks()
    out, before = [], 0
    for _ in range(across * down):
        block = [0] * 64
        before += value(symbol(0))
        block[0], k = before, 1
        while k < 64:
            s = symbol(16)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                block[k] = value(s & 15)
            k += 1
        out.append(block)
    return np.array(out)


def test_media_reads_scans_without_restarts():
    rng = random.Random(4)
    dc, ac = media.codes_of(media._DC), media.codes_of(media._AC)
    bits, before = "", 0
    blocks = [[rng.choice([0, 0, 0, 1, -3, 100]) if k else rng.randint(-60, 60) for k in range(64)] for _ in range(6)]
    for block in blocks:
        size, v = media._value_bits(block[0] - before)
        before = block[0]
        bits += f"{dc[size][0]:0{dc[size][1]}b}" + (f"{v:0{size}b}" if size else "")
        run = 0
        for x in block[1:]:
            if not x:
                run += 1
                continue
            while run > 15:
                bits += f"{ac[0xF0][0]:0{ac[0xF0][1]}b}"
                run -= 16
            size, v = media._value_bits(x)
            code = ac[run << 4 | size]
            bits += f"{code[0]:0{code[1]}b}{v:0{size}b}"
            run = 0
        if run:
            bits += f"{ac[0][0]:0{ac[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = media._segment(0xC0, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0]))
    tables = media._dht(0, media._DC) + media._dht(16, media._AC) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    parsed = media.parse(media._HEAD + frame + tables + scan + b"\xff\xd9")
    got = media.decode([parsed])[0]
    assert (got == np.array(blocks)).all() and (got == plain_decode(parsed)).all()
    with pytest.raises(ValueError):
        media.parse(b"no image")


def test_op9_digests(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.queries()["op9_media"](spark, sf_dir).collect():
        payload = media.padded(texts[r["doc_id"]].encode())
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]].encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_licenses_inherit_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "no notice"),
        (3, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/d/y.py", "none"),
        (5, "e/z.py", "none"),
        (6, "a/b/own.py", "text\nLicensed under CC BY-NC 4.0.\nmore text here and there"),
        (7, None, "none"),
        (8, "a/b/c/d/null", None),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 9)] == ["MIT", "MIT", "GPL-3.0", "GPL-3.0", None, "CC-BY-NC-4.0", None, "GPL-3.0"]
    assert [got[i]["inherited"] for i in range(1, 9)] == [False, True, False, True, False, False, False, True]
    assert got[4]["license_path"] == "a/b/c/COPYING"


def plain_licenses(rows):
    """Every line, window and text against every template; then the directories above, one by one."""
    count = licenses.Counter(w for *_, t in rows for w in set(licenses.tokens(t or "")))
    weigh = lambda w: np.log(1 + len(rows) / max(1, count[w])) if w in known else np.log(1 + len(rows))
    known = set(licenses.words())

    def cosine(a, b):
        a, b = licenses.Counter(a), licenses.Counter(b)
        norm = np.prod([np.sqrt(sum((n * weigh(w)) ** 2 for w, n in x.items())) for x in (a, b)])
        return sum(n * b[w] * weigh(w) ** 2 for w, n in a.items()) / norm if norm else 0.0

    notices = [(n, licenses.tokens(t)) for n, t in licenses.TEMPLATES]
    full = [(n, licenses.tokens(licenses._OWNER.sub("", t))) for n, t in licenses.full_texts()]
    own, file = {}, {}
    for key, path, text in rows:
        found = licenses.tokens(text or "")
        spans = [(cosine(licenses.tokens(line), t), licenses.LINE, n) for line in (text or "").split("\n") for n, t in notices]
        spans += [(cosine(w, t), licenses.WINDOW, n) for n, t in notices for i in range(len(found) - len(t) + 1) if len({*(w := found[i : i + len(t)])} & {*t}) > 1]
        texts = [(cosine(found, t), n) for n, t in notices] + [(cosine(licenses.tokens(licenses._OWNER.sub("", text or "")), t), n) for n, t in full]
        # the first of equal ones
        whole = max(((round(c, 9), n) for c, n in texts if c >= licenses.FILE - 1e-12), default=(0, None), key=lambda x: x[0])
        own[key] = max([whole] + [(round(c, 9), n) for c, least, n in spans if c >= least - 1e-12], key=lambda x: x[0])
        tag = licenses.Matcher(count, len(rows)).tag(text or "")
        own[key] = (1.0, tag) if tag else own[key]
        if path and (whole[1] or (own[key][1] and licenses._NAME.search(path.rsplit("/", 1)[-1]))):
            steps = [x for x in path.split("/") if x]
            file.setdefault("/".join(steps[:-1]), []).append((-max(whole[0], own[key][0]), path, whole[1] or own[key][1]))
    out = {}
    for key, path, _ in rows:
        out[key] = own[key][1]
        steps = [x for x in (path or "").split("/") if x]
        for n in range(len(steps) - 1, -1, -1):
            if path and out[key] is None and "/".join(steps[:n]) in file:
                out[key] = min(file["/".join(steps[:n])])[2]
    return own, out


def test_licenses_match_brute_force(spark, sf_dir):
    texts = dict(licenses.full_texts())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").collect()
    rows = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in docs]
    rows += [(10_000 + i, f"x/{i % 3}//y{i}", t) for i, t in enumerate([*texts.values(), *(f"a b\n{n} words behind it" for _, n in licenses.TEMPLATES), "Released under the MIT", "GNU General Public, version 3", "under CC BY-NC 4.0", "provided that the following conditions are met in source and binary forms with or without modification", None, "", "MIT MIT MIT license license", texts["ISC"][:300]]) if t is None or len(t) < 3000]
    rows += [(20_000, "z/LICENSE", "Released under the MIT License."), (20_001, "z/q/r/s.py", "none"), (20_002, None, "none"), (20_003, "z/q/COPYING.txt", "code under CC BY 4.0."), (20_004, "z/q/r/t.py", None)]
    own, want = plain_licenses(rows)
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert sum(n is not None for _, n in own.values()) > 25 and len(got) == len(rows)
    assert {r["doc_id"]: r["license"] for r in got} == want
    assert all(r["own_license"] == own[r["doc_id"]][1] and np.isclose(r["own_score"], own[r["doc_id"]][0], atol=1e-8) for r in got)


def test_lines_without_a_usual_stem_are_found():
    matcher = licenses.Matcher({}, 1000)
    lines = ["Released under the MIT", "provided that the following conditions are met in source and binary forms with or without modification", "under CC BY-NC 4.0", "GNU General Public, version 3"]
    assert [matcher.text(f"first line\n{line}\nlast line")[1] for line in lines] == ["MIT", "BSD-3-Clause", "CC-BY-NC-4.0", "GPL-3.0"]


def test_full_texts_hold_for_their_directory(spark):
    texts = dict(licenses.full_texts())
    rows = [
        (1, "a/terms.txt", texts["MIT"].replace("MIT License\n", "MIT License\n\nCopyright (c) 2021 Jane Roe\n")),
        (2, "a/b/code.py", "print(1)"),
        (3, "c/terms.txt", texts["GPL-2.0"]),
        (4, "c/code.py", "print(2)"),
        (5, "d/code.py", "print(3)"),
        (6, "d/prose.txt", "A permission to copy this licence was discussed at length by the board."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT", "MIT", "GPL-2.0", "GPL-2.0", None, None]
    assert [got[i]["inherited"] for i in range(1, 7)] == [False, True, False, True, False, False]


def test_headers_within_and_across_lines(spark):
    gpl2 = next(n for name, n in licenses.TEMPLATES if name == "GPL-2.0")
    rows = [
        (1, "# SPDX-License-Identifier: MIT\nx = 1"),
        (2, "// SPDX-License-Identifier: GPL-3.0-or-later"),
        (3, "/* SPDX-License-Identifier: Unknown-1.0 */"),
        (4, "some prose " * 200 + "Released under the MIT License. " + "more prose " * 200),
        (5, "\n# ".join(" ".join(gpl2.split()[i : i + 8]) for i in range(0, 60, 8))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("p/x"))
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan_licenses(df).collect()}
    assert got == {1: "MIT", 2: "GPL-3.0", 3: None, 4: "MIT", 5: "GPL-2.0"}
