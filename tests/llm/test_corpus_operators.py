"""Shuffle, dedup, packing, joins, mixing and the pipeline against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import exact_dedup, jaccard_join, mixing, packing, registry, sharding
from lodestone.llm.jaccard_join import Measure

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# extra columns whose names the operators use themselves, or have used
CLASHING = ["id", "h", "key", "node", "size", "target", "u", "v", "shard", "slot", "bucket", "owner", "count", "row", "part", "place", "cell", "rank", "copy", "number", "data", "row id", "a.b"]
CLASHING += ["_id", "_h", "_source", "_key", "_mix_target", "_mix_draw", "_mix_copy", "lost_id", "lost_text", "of_source", "source_size", "prefix_0", "number_0", "key_0", "score", "label"]


def docs_of(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASHING})


def came_back(df, out):
    """Whether the rows of ``out`` are rows of ``df``, whole."""
    assert out.columns[: len(df.columns)] == df.columns
    known = {tuple(r) for r in df.collect()}
    return all(tuple(r)[: len(df.columns)] in known for r in out.collect())


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one two", "b"), (4, "one two", "b"), (5, "x" * 100_000, "b"), (None, "one two", "c"), (7, "a b c d e f g " * 3000, "c")]


def oracle(sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, sf_dir, name):
    want = oracle(sf_dir, name)
    got = registry.queries()[name](spark, sf_dir).select(*want.columns)
    rounded = lambda rows: Counter(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(map(tuple, got.collect())) == rounded(want.fetchall())


BAD_HASHES = {
    "hash": exact_dedup.text_hash,
    "length": lambda t: F.length(t).cast("long"),  # other texts of the same key chain
    "sign": lambda t: F.when(F.length(t) % 2 == 0, F.lit(-1)).otherwise(F.length(t)).cast("long"),
    "one": lambda t: F.lit(7).cast("long"),
}


@pytest.mark.parametrize("hash_of", BAD_HASHES.values(), ids=BAD_HASHES)
def test_exact_duplicates(spark, hash_of):
    df = docs_of(spark, EDGES)
    got = exact_dedup.exact_duplicates(df, capacity=2, hash_of=hash_of).collect()
    assert len(got) == len(EDGES)
    by_text = defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r)
    assert sorted(len(v) for v in by_text.values()) == [1, 1, 1, 2, 3]
    assert {r["keep_id"] for r in got if r["group_size"] == 3} == {4}
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    kept = exact_dedup.drop_copies(df, capacity=2, hash_of=hash_of)
    assert kept.columns == df.columns and came_back(df, kept)
    assert Counter(r["text"] for r in kept.collect() if r["text"]) == Counter(t for t in {t for _, t, _ in EDGES} if t)
    assert kept.count() == 5
    assert exact_dedup.exact_duplicates(df.limit(0)).collect() == exact_dedup.drop_copies(df.limit(0)).collect() == []


@pytest.mark.parametrize("hash_of", BAD_HASHES.values(), ids=BAD_HASHES)
def test_exact_duplicates_against_groups(spark, hash_of):
    rng = np.random.default_rng(8)
    texts = ["same"] * 400 + [f"t{i}" for i in rng.integers(0, 300, 1500)] + [f"{'x' * (i % 9)} {i}" for i in range(300)]
    rows = [(int(i), texts[i], "s") for i in rng.permutation(len(texts))]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows).repartition(5), capacity=4, hash_of=hash_of).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    of = {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted((i, *v) for i, v in of.items())
    kept = exact_dedup.drop_copies(docs_of(spark, rows), capacity=4, hash_of=hash_of).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(map(max, groups.values()))


def test_the_index_holds_bytes_and_finds_later_rows(spark):
    index = exact_dedup.build_index(docs_of(spark, EDGES), capacity=2, hash_of=BAD_HASHES["length"])
    entries = index.entries.collect()
    assert sorted(e["text"] for e in entries) == sorted({t or "" for _, t, _ in EDGES})
    assert all(e["sha256"] == hashlib.sha256(e["text"].encode()).hexdigest() for e in entries)
    assert sum(e["group_size"] for e in entries) == len(EDGES)
    later = spark.createDataFrame([("one two",), ("six six",), ("no",), ("",)], "text string").withColumn("h", F.length("text").cast("long"))
    found = {r["text"]: r["keep_id"] for r in exact_dedup.look_up(later, index).collect()}
    assert found == {"one two": 4, "six six": None, "no": None, "": 2}


def test_copies_meet_only_through_the_directory(spark, monkeypatch):
    rows = [(i, f"t{i % 40}", "s") for i in range(160)]
    want = exact_dedup.exact_duplicates(docs_of(spark, rows), capacity=4).where("kept").count()
    assert want == 40
    right = exact_dedup.Directory.find

    def wrong(self, rows, key="h"):
        found = right(self, rows, key)
        return found.withColumn("bucket", F.col("bucket") + F.floor(F.col("id") / 40) % 2) if "id" in found.columns else found

    monkeypatch.setattr(exact_dedup.Directory, "find", wrong)
    monkeypatch.setattr(exact_dedup, "HOT_KEYS", 1)
    assert exact_dedup.exact_duplicates(docs_of(spark, rows), capacity=4).where("kept").count() > want


@pytest.mark.parametrize("owner_bytes", [300, 1 << 30])
@pytest.mark.parametrize("hash_of", ["text", "length"])
def test_hot_keys_are_found_by_bytes(spark, monkeypatch, owner_bytes, hash_of):
    # half of the bytes are copies of one text, and with the bad hash other texts collide with it
    rows = [(i, "hot one", "s") for i in range(120)] + [(200 + i, f"cold{i % 50:03d}"[:7], "s") for i in range(120)] + [(None, "hot one", "s"), (500, "", "s"), (501, None, "s"), (7, "hot one", "s")]
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", owner_bytes)
    monkeypatch.setattr(exact_dedup, "HOT_KEYS", 4)
    hashed = BAD_HASHES["length"] if hash_of == "length" else exact_dedup.text_hash
    df = docs_of(spark, rows)
    index = exact_dedup.build_index(df, capacity=4, hash_of=hashed)
    assert index.directory.hot is not None
    if owner_bytes == 300:
        assert index.directory.hot.agg(F.max("parts")).first()[0] > 10  # spread over many parts
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(df, capacity=4, hash_of=hashed).select("doc_id", "keep_id", "group_size").collect()), key=str)
    want = sorted(((i, max(g for g in groups[t or ""] if g is not None), len(groups[t or ""])) for i, t, _ in rows), key=str)
    assert got == want
    later = spark.createDataFrame([("hot one", 1), ("hot two", 2), ("", 3)], "text string, parts long").withColumn("h", hashed(F.col("text")))
    found = {r["text"]: (r["keep_id"], r["parts"]) for r in exact_dedup.look_up(later, index).collect()}
    assert found == {"hot one": (119, 1), "hot two": (None, 2), "": (501, 3)}


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    buckets = exact_dedup.grow_directory(keys, 100)
    assert all(0 < b.entries <= 100 for b in buckets)
    assert sum(2.0**-b.depth for b in buckets) == 1  # they cover all keys once
    assert sum(b.entries for b in buckets) == 3000
    same = spark.range(50).select(F.lit(5).cast("long").alias("h")).distinct()
    assert [(b.depth, b.entries) for b in exact_dedup.grow_directory(same, 10)] == [(0, 1)]  # equal keys chain


@pytest.mark.parametrize("shift", [0, 13, 50, 63])
def test_every_key_finds_its_own_bucket(spark, shift):
    # the first keys need as many bits as the shift and more
    close = spark.range(1 << min(11, 64 - shift)).select(F.shiftleft(F.lit(1).cast("long"), 63 - shift).bitwiseXOR(F.col("id")).alias("h"))
    keys = close.unionByName(spark.range(2000).select(F.xxhash64("id").alias("h"))).distinct()
    buckets = exact_dedup.grow_directory(keys, 1)
    assert max(b.depth for b in buckets) >= 13 and len(buckets) == keys.count()
    found = exact_dedup.Directory(spark, buckets, 3, 1, None).find(keys).collect()
    for r in found:
        b = buckets[r["bucket"]]
        assert (r["h"] & (1 << 64) - 1) >> (64 - b.depth) == b.prefix
    assert len({r["bucket"] for r in found}) == len(found)


@pytest.mark.parametrize("rows", [0, 1, 15, 16, 1000])
def test_shards(spark, rows):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("size"))
    got = sharding.uniform_shards(df.repartition(5)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(rows))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, ())) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("small", [sharding.SMALL, 0])
def test_communication_matrix(monkeypatch, small):
    monkeypatch.setattr(sharding, "SMALL", small)
    m = sharding.communication_matrix({0: 10, 3: 0, 5: 33}, 16, 1)
    assert {p: sum(v) for p, v in m.items()} == {0: 10, 3: 0, 5: 33}
    assert np.ptp(np.sum(list(m.values()), axis=0)) <= 1
    for good, bad, draws in [(400, 100, 50), (3, 5, 8), (0, 5, 2), (5, 0, 2), (7, 9, 0), (20, 30, 45), (1, 400, 200)]:
        drawn = np.array([sharding.hypergeometric(np.random.default_rng(i), good, bad, draws) for i in range(2000)])
        mean = draws * good / (good + bad)
        sd = (mean * bad / (good + bad) * (good + bad - draws) / max(1, good + bad - 1)) ** 0.5
        assert abs(drawn.mean() - mean) <= sd * 0.1 and abs(drawn.std() - sd) <= 0.1 * sd
        assert drawn.min() >= max(0, draws - bad) and drawn.max() <= min(draws, good)


def test_communication_matrix_of_many_rows():
    m = sharding.communication_matrix({p: 10**9 for p in range(30)}, 16, 3)
    assert all(sum(v) == 10**9 for v in m.values()) and np.ptp(np.sum(list(m.values()), axis=0)) <= 1
    sd = (10**9 / 16 * 15 / 16) ** 0.5
    assert 0.7 * sd < np.std([x for v in m.values() for x in v]) < 1.3 * sd


def test_shards_of_edge_rows(spark):
    df = docs_of(spark, EDGES)
    got = sharding.uniform_shards(df)
    assert got.columns == [*df.columns, "shard_", "slot_"] and came_back(df, got) and got.count() == len(EDGES)


def test_op2_shards(spark, sf_dir):
    texts = {r[0]: (r[1] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["op2_shards"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert len(got) == len(texts) and {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, i) for s, n in Counter(r["shard"] for r in got).items() for i in range(n))
    null = spark.createDataFrame([(1, None)], "doc_id long, text string").select(*sharding.described(F.coalesce("text", F.lit("")))).first()
    assert tuple(null) == (1, 0)


def test_packing_holds_every_id_once(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = docs_of(spark, EDGES).select("doc_id", "text", "source").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", "source"))
    df = df.unionByName(spark.createDataFrame([(51, "<|endoftext|>", "z"), (52, "a  <|endoftext|><|endoftext|>  b<|endoftext|", "z"), (50, "<|endoftext|> ½ 中文字 🙂🙂 don't ​ x\r\n\r\n   y 12345 ٣٤", "z")], "doc_id long, text string, source string"))
    pieces = packing.pack(df, with_ids=True).collect()
    want = defaultdict(list)
    for r in df.collect():
        want[r["doc_id"]].append(tuple(reference.encode(r["text"] or "", add_special_tokens=False).ids) + (0,))
    got = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (str(p["doc_id"]), p["start"])):
        assert p["length"] == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        got[p["doc_id"]] += p["ids"]
    for key, texts in want.items():
        if len(texts) == 1:
            assert tuple(got[key]) == texts[0]
        else:
            assert Counter(got[key]) == Counter(itertools.chain(*texts))
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for w in windows.values():
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(w)))
        assert min(w)[0] == 0 and sum(n for _, n in w) <= 1024
    assert sum(p["length"] for p in pieces) > 0.93 * 1024 * len(windows)
    assert packing.pack(df.limit(0)).collect() == []


def test_ids_match_the_tokenizers_library_around_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = packing.encoder(packing.vocabulary()), np.random.default_rng(6)
    parts = np.array(["<|endoftext|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "a", "don't", "½", "中文", "🙂", "12", "\u200b", "\r\n", "<|endoftext|"])
    texts = ["".join(parts[rng.integers(0, len(parts), rng.integers(0, 12))]) for _ in range(30_000)]
    want = [x.ids for x in reference.encode_batch(texts, add_special_tokens=False)]
    assert [encode(t) for t in texts] == want
    assert sum(50256 in x for x in want) > 5_000


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 1024)
    windows = -(-int(sizes.sum()) // 1024)
    sums, after, heads = packing.differencing(sizes, windows)
    assert sums.sum() == sizes.sum() and sums[0] - sums[-1] < 30
    packed = packing.pack_block(sizes.tolist(), 1024)
    assert sorted(i for w in packed for i in w) == list(range(1024))
    assert max(sum(sizes[i] for i in w) for w in packed) <= 1024 and len(packed) <= windows + 1
    # three pieces of 600 need three windows though two would hold their ids
    assert len(packing.pack_block([600, 600, 600], 1024)) == 3


def plain_components(docs, m):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        sets.append({tuple(w[j : j + m.words]) for j in range(len(w) - m.words + 1)} if len(w) >= m.words else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * m.den >= m.num * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(docs):
        least[root(i)].append(key)
    return sorted((str(docs[i][0]), len(sets[i]), min((k for k in least[root(i)] if k is not None), default=None)) for i in range(len(docs)))


def noisy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(  # bounds are HOMES, LEAF, PIVOTS, CROWD
    ("m", "bounds"), [(Measure(3, 9, 10), None), (Measure(5, 4, 5), (0, 2, 2, 0)), (Measure(2, 1, 2), (1, 6, 3, 1))]
)
def test_components(spark, m, bounds, monkeypatch):
    for name, value in zip(("HOMES", "LEAF", "PIVOTS", "CROWD"), bounds or (), strict=False):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(m.words)
    rows = [(i, t) for i, t, _ in EDGES]
    passage = " ".join(f"p{i}" for i in range(60))
    for base in range(8):
        n = int(rng.choice([2, 4, 7, 12, 40, 150, 400]))
        words = [f"b{base}x{i}" for i in range(n)]
        for _ in range(14):
            rows.append((len(rows) + 100, noisy(rng, words, int(rng.integers(0, max(2, n // (6 * m.words) + 2))))))
    rows += [(1000 + i, f"{passage} " + " ".join(f"u{i}y{j}" for j in range(rng.integers(5, 200)))) for i in range(40)]
    got = jaccard_join.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3), measure=m).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, m)


def chain(rng, name, m):
    """A hub P with near copies, w that is linked with P, and u that is linked with w alone."""
    while True:
        n, x, y = int(rng.integers(20, 200)), int(rng.integers(1, 8)), int(rng.integers(1, 16))
        linked = lambda a, b: a * m.den >= m.num * b
        if linked(n, n + x) and linked(n + x, n + x + y) and not linked(n, n + x + y):
            break
    hub = [f"{name}p{i}" for i in range(n + m.words - 1)]
    tail = [f"{name}x{i}" for i in range(x + y)]
    near = [noisy(rng, hub, 1) for _ in range(4)] if linked(n - m.words, n + m.words) else []
    copies = [" ".join([*hub[i:], *(f"{name}e{i}n{j}" for j in range(i))]) for i in range(3) if linked(n - i, n + i)]
    return [*near, *copies, " ".join(hub + tail[:x]), " ".join(hub + tail)]


@pytest.mark.parametrize("m", [Measure(3, 9, 10), Measure(5, 4, 5)])
def test_links_of_sets_just_beyond_a_pivot(spark, m):
    rng = np.random.default_rng(m.words)
    words = [f"p{i}" for i in range(20 + m.words - 1)]
    tails = [f"x{i}" for i in range(40)]
    a, b = (1, 3) if m.words == 3 else (3, 7)  # J(P, w) and J(w, u) reach the threshold, J(P, u) does not
    rows = [(1, " ".join(words)), (2, " ".join(words + tails[:a])), (3, " ".join(words + tails[:b]))]
    rows += [(4 + i, " ".join([*words[:-1], f"end{i}"])) for i in range(8)]
    for i in range(60):
        rows += [(1000 * (i + 1) + j, t) for j, t in enumerate(chain(rng, f"c{i}", m))]
    got = jaccard_join.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]), measure=m).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 4} == {1}
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, m)


def hub_with_outliers(rng, copies, outliers, words=200):
    """Copies that vary one or two of ten places, and outliers that vary more of them, up to and past the threshold."""
    template = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(copies + outliers):
        text = list(template)
        many = int(rng.integers(1, 3)) if i < copies else int(rng.integers(2, 6))
        for place in rng.choice(10, many, replace=False):
            text[place * words // 10] = f"v{place}x{rng.integers(3)}"
        rows.append((i + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("crowd", [0, 3, 32])
def test_hub_of_near_copies_with_outliers(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    m, rows = Measure(3, 9, 10), hub_with_outliers(np.random.default_rng(crowd), 200, 60)
    got = jaccard_join.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]), measure=m).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, m)


@pytest.mark.parametrize("crowd", [0, 2, 100])
def test_meetings_of_crowds(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    m, rng = Measure(3, 9, 10), np.random.default_rng(4)
    rows = []
    for u in range(60):
        label, linked, nu, far = int(rng.integers(4)), bool(rng.integers(4) == 0), int(rng.integers(90, 110)), int(rng.integers(4, 12))
        for item in rng.choice(12, 3, replace=False).tolist():
            rows.append((item % 2, u, nu, (linked, 0 if linked else label), label, far, item, int(rng.integers(1, far + 1))))
    schema = "cell long, u long, nu long, crowd struct<linked: boolean, of: long>, label long, far int, item long, left int"
    got = jaccard_join.meetings(spark.createDataFrame(rows, schema).repartition(3), m).collect()
    want = defaultdict(set)
    for (c1, u1, n1, k1, l1, f1, i1, r1), (c2, u2, n2, k2, l2, f2, i2, r2) in itertools.combinations(rows, 2):
        most = (n1 + n2) * 1 / 19
        if (c1, i1) == (c2, i2) and k1 != k2 and l1 != l2 and abs(f1 - f2) <= most and 2 * min(r1, r2) >= f1 + f2 - most:
            want[min(u1, u2), max(u1, u2)].add(c1)
    assert len(want) > 50 and {(r["u"], r["v"]): r["cell"] for r in got} == {pair: min(cells) for pair, cells in want.items()}


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(9)
    for m in (Measure(3, 9, 10), Measure(5, 4, 5), Measure(2, 1, 2)):
        for n in [1, 2, 3, 4, 5, 6, 9, 10, 11, 17, 19, 20, 40, 99, 100, 300]:
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                most = m.apart(len(a))
                drop = int(rng.integers(0, most + 1))
                b = a.copy()
                rng.shuffle(b)
                b = np.unique(np.concatenate([b[drop:], rng.integers(0, 2**63, int(rng.integers(0, most - drop + 1))).astype(np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if not len(b) or inter * m.den < m.num * (len(a) + len(b) - inter):
                    continue
                sig, many, least = jaccard_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), m)
                assert len(set(sig[: many[0]].tolist()) & set(sig[many[0] :].tolist())) >= max(least)


def test_one_of_each_and_empty_tables(spark):
    df = docs_of(spark, [(i, t, s) for i, t, s in EDGES])
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and came_back(df, kept)
    assert jaccard_join.one_of_each(df.limit(0)).collect() == []
    assert jaccard_join.jaccard_components(df.limit(0)).collect() == []


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(4000)] + EDGES
    df = docs_of(spark, rows)
    sized = df.select("source", mixing.word_count("text").alias("size"))
    rates = mixing.targets(sized).collect()
    total = sum(r["source_size"] for r in rates)
    assert np.isclose(sum(r["target"] for r in rates), total)
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in rates)
    out = mixing.mix_sources(df)
    assert out.columns == df.columns and came_back(df, out)
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    for r in rates:
        if r["source"] and r["source"].startswith("s"):
            assert abs(taken[r["source"]] / r["target"] - 1) < 0.1
    assert max(r["count"] for r in out.where("doc_id >= 8").groupBy("doc_id").count().withColumnRenamed("count", "n").select(F.col("n").alias("count")).collect()) <= 6
    again = mixing.mix_sources(df.repartition(7))
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in out.collect())
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_targets_fill_up_by_weight(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1), ("c", 100), (None, 10)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    # weights 1, 2, 3, 1: b stops at 3; the null source at 30; 178 are left for a and c
    left = 211 - 3 - 30
    assert got == {"b": 3.0, None: pytest.approx(min(30, (211 - 3) / 5)) if (211 - 3) / 5 < 30 else 30.0, "a": pytest.approx(left / 4), "c": pytest.approx(left * 3 / 4)}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        steps.append(docs.collect())
        if name != "pack":
            assert docs.columns == columns
    raw, good, distinct, dissimilar, mixed, packed = steps
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = {r["doc_id"] for r in raw if labels.get(r["doc_id"]) == 1}
    assert len(clean & {r["doc_id"] for r in good}) > 0.95 * len(clean)
    assert {r["text"] for r in distinct} == {r["text"] for r in good} and len(distinct) == len({r["text"] for r in good})
    m = Measure(5, 4, 5)
    want = plain_components([(r["doc_id"], r["text"]) for r in distinct], m)
    assert sorted(r["doc_id"] for r in dissimilar) == sorted(int(i) for i, _, c in want if int(i) == c)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in dissimilar}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_pipeline_stages_take_edge_rows(spark):
    sf = "/root/testdata/sf0.001"
    df = docs_of(spark, EDGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf).collect() == [], name
        out = stage(spark, df, sf)
        if name != "pack":
            assert out.columns == df.columns and came_back(df, out), name
        else:
            assert {r["doc_id"] for r in out.collect()} == {i for i, _, _ in EDGES}
