import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from setloom.llm import embedding, simhash, simhash_dedup
from setloom.llm.common import components
from setloom.llm.queries import op3_simhash, op5_embedding_dedup


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(keys, 2):
        if linked(a, b) and (x := find(a)) != (y := find(b)):
            up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def check_simhash(rows, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_simhash_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_simhash(op3_simhash(spark, sf).collect(), docs)


def test_simhash_odd_rows(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    long = " ".join(r.choices(words, k=60_000))
    texts = dict(enumerate([None, "", " \t\n", "A b", "a B", "a b c d", "É é", "x\x0by\x1cz", long, long + " tail", long.upper(), *(" ".join(r.choices(words, k=300)) for _ in range(20))]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS root", "2 AS component_id")
    check_simhash(simhash.simhash_components(df).collect(), texts)
    twice = simhash.simhash_components(df.unionByName(df))
    assert twice.count() == 2 * len(texts)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (None, "b")], "doc_id long, text string")
    assert sorted((x["doc_id"] is None, x["component_id"] or 0) for x in simhash.simhash_components(nulls).collect()) == [(False, 5), (True, 0), (True, 0), (True, 5)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_every_close_pair_shares_a_shard(k):
    r = random.Random(k)
    choices = simhash.block_choices({1: 1, 2: 10**6, 3: 10**9}[k], 4)
    assert len(choices[0]) == k
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        part = lambda x, c: tuple(x >> s & (1 << w) - 1 for s, w in c)
        assert any(part(a, c) == part(b, c) for c in choices)


@pytest.mark.parametrize("spread", [3, 64])
def test_tree_links_equal_brute_force(spread):
    r = random.Random(spread)
    base = [r.getrandbits(64) for _ in range(12)]
    values = list({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, spread) % 7)) for b in base for _ in range(25)})
    edges = simhash.spanning_links(values, 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in edges) and len(edges) < len(values)
    up = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    joined = {(min(a, b), max(a, b)) for a, b in edges}
    assert brute_components(values, lambda a, b: (min(a, b), max(a, b)) in joined) == up


@pytest.mark.parametrize("full", [4, 60, 10_000])
def test_full_shards_lose_no_link(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)
    r = random.Random(full)
    base = [r.getrandbits(64) for _ in range(3)]
    common = r.getrandbits(64) & ~0xFFFFFFFF  # half the bits of many agree
    values = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 9))) for b in base for _ in range(60)}
    values = sorted(values | {common | r.getrandbits(20) for _ in range(200)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {x["fp"] % (1 << 64): x["root"] % (1 << 64) for x in simhash.hamming_components(df, 4).collect()}
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda of: {frozenset(k for k in of if of[k] == c) for c in set(of.values())}
    assert groups({v: got.get(v, v) for v in values}) == groups(want)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randint(0, 99), r.randint(0, 99)) for _ in range(60)] + [(7, 7)] + [(500, 500 + i) for i in range(1, 80)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    linked = set(edges)
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    want = brute_components(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard(a, b, width=5):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_drop_near_duplicates(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    shared = r.choices(words, k=30)
    texts, groups = [], []
    for g in range(40):
        base = r.choices(words, k=200) + shared
        for c in range(1 + g % 4):
            w = list(base)
            for i in r.sample(range(200), c):  # each changed word costs up to five shingles
                w[i] = f"x{g}-{c}-{i}"
            texts.append(" ".join(w))
            groups.append(g)
    texts += [texts[0].upper(), None, "", "  "]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS `group`", "1 AS node")
    got = sorted(x["doc_id"] for x in simhash_dedup.drop_near_duplicates(df).collect())
    of = dict(rows)
    want = brute_components(list(of), lambda a, b: jaccard(of[a], of[b]) >= 0.8)
    assert got == sorted(set(want.values()))
    assert simhash_dedup.drop_near_duplicates(df).columns == df.columns
    assert simhash_dedup.drop_near_duplicates(df.limit(0)).count() == 0
    assert simhash_dedup.drop_near_duplicates(df.unionByName(df)).count() == len(got)


def test_similar_links_are_exact():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, np.r_[a[:89], a[:11] + np.uint64(1000)], np.r_[a[:88], a[:12] + np.uint64(1000)]]
    assert simhash_dedup.similar_links([1, 2], sets[:2], 0.8) == [(1, 2)]
    assert simhash_dedup.similar_links([1, 3], [sets[0], sets[2]], 0.8) == []


@pytest.mark.parametrize("seed", range(4))
def test_similar_links_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(5000, rng.integers(1, 60), replace=False) for _ in range(6)]
    grams = []
    for _ in range(4 if seed == 3 else 60):
        b = base[rng.integers(6)]
        kept = b[rng.random(len(b)) > 0.1 * rng.random()]
        grams.append(np.unique(np.r_[kept, rng.integers(5000, 9000, rng.integers(1, 4))]).astype(np.uint64))
    n = len(grams)
    near = lambda i, j: len(np.intersect1d(grams[i], grams[j])) >= 0.8 * len(np.union1d(grams[i], grams[j]))
    links = {tuple(sorted(x)) for x in simhash_dedup.similar_links(list(range(n)), grams, 0.8)}
    assert all(near(*x) for x in links) and len(links) < n
    assert brute_components(range(n), lambda i, j: (i, j) in links) == brute_components(range(n), near)
    left, label = rng.random(n) < 0.5, np.arange(n) % 3
    links = {tuple(sorted(x)) for x in simhash_dedup.similar_links(list(range(n)), grams, 0.8, label, left)}
    assert all(near(i, j) and left[i] != left[j] and label[i] != label[j] for i, j in links)
    joined = lambda i, j: label[i] == label[j]
    assert brute_components(range(n), lambda i, j: joined(i, j) or (i, j) in links) == brute_components(range(n), lambda i, j: joined(i, j) or near(i, j) and left[i] != left[j])


def test_split_shards_and_groups_lose_no_link(spark, monkeypatch):
    """One third are near copies of one text, others share a passage and have copies among themselves."""
    for name, value in (("FULL", 16), ("BLOCK", 12)):
        monkeypatch.setattr(simhash_dedup, name, value)
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base, passage = r.choices(words, k=120), r.choices(words, k=70)
    texts = []
    for k in range(90):
        w = list(base)
        w[r.randrange(120)] = f"x{k}"
        texts.append(" ".join(w))
    for k in range(60):
        own = r.choices(words, k=30)
        texts += [" ".join(passage + own), " ".join(passage + own + r.choices(words, k=4))]
    for k in range(40):  # a chain: each links with the next alone
        texts.append(" ".join(f"c{i}" for i in range(9 * k, 9 * k + 104)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(x["doc_id"] for x in simhash_dedup.drop_near_duplicates(df).collect())
    want = brute_components(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(want.values())) <= 65
    missed = set(got) - set(want.values())
    assert set(got) >= set(want.values()) and len(missed) <= 3


def test_recall_of_pairs_near_the_threshold(spark):
    """Planted pairs of similarity 0.80 to 0.85, by length, among others that share passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    passage, rows, pairs = [word() for _ in range(60)], [], []
    for k in range(600):
        n = (30, 60, 150, 400, 1500)[k % 5]
        a = [word() for _ in range(n)]
        if k % 3 == 0:
            m = min(60, n // 4)
            a[n // 2 : n // 2 + m] = passage[:m]
        b = list(a)
        if n == 30:
            b += [word() for _ in range((n - 4) // 4)]
        for i in range((n - 4) // 45):  # each changed word costs five shingles
            b[i * 45 + 10 + r.randrange(20)] = word()
        assert 0.8 <= jaccard(" ".join(a), " ".join(b)) <= 0.85
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append((n, 2 * k + 1))
    kept = {x["doc_id"] for x in simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(600))
    for n in (30, 60, 150, 400, 1500):
        of = [i for m, i in pairs if m == n]
        found = sum(i not in kept for i in of) / len(of)
        print(n, found)
        assert found >= 0.95, n


def test_short_texts_at_the_threshold_all_link(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    rows = []
    for k in range(600):
        a = [word() for _ in range((8, 16, 20)[k % 3])]
        b = a + [word() for _ in range((1, 3, 4)[k % 3])]  # 4 of 5, 12 of 15 and 16 of 20 shingles
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    assert all(jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 for k in range(600))
    got = {x["doc_id"] for x in simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * k for k in range(600)}


def brute_links(rows):
    good = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float) / np.abs(np.array(v, float)).max()
        good[i] = (label, x / np.linalg.norm(x))
    near = lambda a, b: good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and float(good[a][1] @ good[b][1]) >= 0.93
    of = brute_components(list(good), near)
    return {i: (sum(near(i, j) for j in good if j != i) if i in good else 0, of.get(i, i)) for i, _, _ in rows}


def test_embeddings_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op5_embedding_dedup(spark, sf).collect()}
    assert got == brute_links(rows)


def test_embeddings_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for c in range(6):
        center = rng.standard_normal(32)
        for _ in range(40):
            rows.append((i, (center + rng.standard_normal(32) * 0.15).tolist(), c % 2))
            i += 1
    same = rows[0][1]
    odd = [same, same, [2 * x for x in same], None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, same[:31], [1e-200 * x for x in same]]
    rows += [(i + k, v, 0) for k, v in enumerate(odd)] + [(i + 50, same, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS weight", "3 AS kept")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(df).collect()}
    want = brute_links(rows)
    links, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert set(got) == set(want) and all(got[k][0] <= want[k][0] for k in want) and found >= 0.97 * links
    assert {k for k, (n, _) in got.items() if n == 0} == {k for k, (n, _) in want.items() if n == 0}
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.97 * len(want)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (0.9301 * a + np.sqrt(1 - 0.9301**2) * b).tolist(), 1)]
    out = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in out) / 600 >= 0.95
