"""The mixture's guarantees, the native plan, and the pipeline stage by stage."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setloom.llm import mixing
from setloom.llm.queries import op8_mixing
from tests.llm.test_near_duplicates import brute_components, jaccard
from tests.llm.test_tokens_packing import check_packing


def brute_schedule(a):
    period, nxt, out = sum(a), [0] * len(a), []
    for t in range(period):
        i = min((i for i in range(len(a)) if nxt[i] * period // a[i] <= t), key=lambda i: (-(-(nxt[i] + 1) * period // a[i]), i))
        nxt[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_schedule_stays_within_a_block(spark, seed):
    r = random.Random(seed)
    a = [r.randint(1, 60) for _ in range(12)]
    shared = spark.createDataFrame([(f"s{i:02d}", x, 1000) for i, x in enumerate(a)], "src string, a long, total long")
    slots = {x["src"]: x["slots"] for x in mixing.schedule(shared).collect()}
    order = brute_schedule(a)
    assert [slots[f"s{i:02d}"] for i in range(12)] == [[t for t, j in enumerate(order) if j == i] for i in range(12)]
    served = [0] * 12
    for t, i in enumerate(order, 1):
        served[i] += 1
        assert all(abs(n - t * x / sum(a)) < 1 for n, x in zip(served, a))


def check_mix(rows, docs, block, key=lambda r: r["source"]):
    sizes, per_slot = Counter(), {}
    for _, s, t in docs:
        sizes[s] += max(1, len((t or "").encode()))
    for r in rows:
        assert per_slot.setdefault(r["slot"], (key(r), r["block"])) == (key(r), r["block"])
    seen = Counter((r["doc_id"], key(r)) for r in rows)
    assert set(seen) == {(i, s) for i, s, _ in docs}
    return sizes


def test_mix_places_everything(spark):
    r = random.Random(1)
    docs = [(i, "big" if i % 3 else f"s{i % 5}", "x" * r.randint(0, 400)) for i in range(900)] + [(1000, None, "null source"), (1001, "", None), (None, "s1", "a"), (7, "s1", "a"), (7, "s1", "a")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS slot", "2 AS src", "3 AS bytes")
    out = mixing.mix(df, block_bytes=512).collect()
    sizes = check_mix(out, docs, 512)
    w = {s: n**mixing.TEMPER for s, n in sizes.items()}
    a = {s: max(1, math.floor(x / sum(w.values()) * mixing.PERIOD)) for s, x in w.items()}
    blocks = {s: -(-n // 512) for s, n in sizes.items()}
    last = max(x["slot"] for x in out) + 1
    for s in sizes:
        placed = max(x["block"] for x in out if x["source"] == s) + 1
        assert abs(placed - last * a[s] / sum(a.values())) <= 2, s  # a block, and one that a long text left empty
        assert placed >= blocks[s] or blocks[s] == 1
    starts, at = {}, defaultdict(int)
    digest = lambda i, t: md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()
    for i, s, t in sorted(docs, key=lambda d: digest(d[0], d[2])):
        starts.setdefault((i, s), at[s] // 512)
        at[s] += max(1, len((t or "").encode()))
    for x in out:
        if (x["doc_id"], x["source"]) != (7, "s1"):
            assert x["block"] == x["epoch"] * blocks[x["source"]] + starts[x["doc_id"], x["source"]]
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_targets_and_bound(spark):
    docs = [(i, "ab"[i % 2], "x" * 100) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    wanted = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    out = Counter(r["source"] for r in mixing.mix(df, wanted, block_bytes=1000).collect())
    assert out["b"] == 200 and abs(out["a"] / out["b"] - 3) < 0.1
    with pytest.raises(Exception, match="raise the period"):
        mixing.mix(df.withColumn("source", F.col("doc_id").cast("string")), period=10).count()


def test_odd_targets(spark):
    sizes = spark.createDataFrame([("a", 300), ("b", 100)], "src string, total long")

    def shares(*rows):
        return {r["src"]: r["a"] for r in mixing.shares(sizes, spark.createDataFrame(list(rows), "src string, w double"), 100).collect()}

    assert shares(("a", 1.0), ("a", 2.0), ("b", 1.0)) == shares(("a", 3.0), ("b", 1.0)) == {"a": 75, "b": 25}
    assert shares(("a", 0.0), ("b", 0.0)) == shares(("other", 5.0)) == {"a": 50, "b": 50}
    assert shares(("a", 1.0), ("b", None)) == shares(("a", 1.0), ("b", 0.0)) == shares(("a", 1.0), ("other", 5.0)) == {"a": 100, "b": 1}
    for bad in (float("nan"), -1.0, float("inf")):
        with pytest.raises(Exception, match="no weight"):
            shares(("a", bad), ("b", 1.0))


def test_rows_that_repeat_often(spark):
    df = spark.createDataFrame([(i, "big" if i else "one", "x" * 1000) for i in range(1501)], "doc_id long, source string, text string")
    wanted = spark.createDataFrame([("big", 1.0), ("one", 1.0)], "source string, weight double")
    out = mixing.mix(df, wanted, block_bytes=1000).collect()
    one = sorted((r["epoch"], r["block"], r["slot"]) for r in out if r["source"] == "one")
    assert len(one) > 20 * mixing.EPOCHS and [(e, b) for e, b, _ in one] == [(i, i) for i in range(len(one))]
    assert len({r["slot"] for r in out}) == len(out) and max(r["slot"] for r in out) == len(out) - 1
    with pytest.raises(Exception, match="repeats of source one"):
        mixing.mix(df, wanted, block_bytes=1000, most_repeats=100).count()


def test_mix_plan_is_native(spark, sf):
    plan = op8_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mixing", "packing"]
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    rows = {r["doc_id"]: r for r in kept.collect()}
    once = corpus_pipeline.near_dedup(spark, kept, sf)
    assert once.columns == docs.columns
    by_text = {i: r["text"] for i, r in rows.items()}
    want = brute_components(list(by_text), lambda a, b: jaccard(by_text[a], by_text[b]) >= 0.8)
    got = {r["doc_id"] for r in once.collect()}
    assert got >= set(want.values()) and len(got - set(want.values())) <= 0.05 * max(1, len(want) - len(set(want.values())))
    mixed = corpus_pipeline.mix_sources(spark, once, sf)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == got
    packed = corpus_pipeline.pack(spark, mixed, sf).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()])


def test_pipeline_survives_nulls_and_emptiness(spark):
    rows = [(None, None, None, None, None), (1, "the water and the house", None, None, None), (1, "the water and the house", None, None, None), (2, "", "en", "s", 0), (3, "das haus ist hier", "de", "s", 17), (4, "the other one is here", "en", None, 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS epoch", "2 AS slot", "'x' AS rejected", "3 AS row", "4 AS `group`", "5 AS rank", "6 AS _k")
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
        assert {r["doc_id"] for r in now.collect()} == ({1, 3, 4} if given is docs else set())
