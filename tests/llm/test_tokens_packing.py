import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setloom.llm import packing, tokens
from setloom.llm.queries import op1_token_counts, op4_packing, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ALPHABET = ["a", "Be", "é", "ß", "İ", "Σ", " ", "  ", "\n", "\t", "\r", " ", "\x1c", "\x85", "\0", "1", "22", "'s", "'", "!", "<|endoftext|>", "<|startoftext|>", "̈", "中", "😀", "ﬁ", "_", "the"]
ODD = [None, "", " ", "\n", "a", "  a  ", "x <|endoftext|>y", "word " * 30000, "x" * 50000, "İstanbul Σας", "a\x1cb \0 c"]


def library(path, text):
    return tokens.parts(path, path == BYTE).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), st.text(max_size=40)))
def test_parts_equal_the_library(text):
    assert sum(tokens.parts(BYTE, True).of([text])[0]) == len(library(BYTE, text))
    assert b"".join(tokens.parts(WORD, False).of([text])[0]) == np.array(library(WORD, text), "<u4").tobytes()


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (3, "\n"), (3, "\n")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "7 AS n_tokens", "'x' AS n_bytes")
    got = Counter(map(tuple, tokens.token_counts(df, BYTE).collect()))
    want = Counter((i, len((t or "").encode()), n := len(library(BYTE, t)), n > 1024) for i, t in rows)
    assert got == want
    assert tokens.token_counts(df.limit(0), BYTE).count() == 0


def test_counts_of_the_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op1_token_counts(spark, sf).collect()
    assert len(out) == len(docs) and all(r["n_tokens"] == len(library(BYTE, docs[r["doc_id"]])) for r in out)


def check_packing(rows, texts, capacity=4096):
    """Pieces are right, sequences have no gap, no overlap and no overflow."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[0]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for key, text in texts:
        ids = library(WORD, text) + [1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            some = ids[s : s + capacity]
            want[key, p, s, len(some), crc32(np.array(some, "<u4").tobytes())] += 1
    assert Counter((r[0], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(n for v in seqs.values() for _, n in v)


def test_pack_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "\n"), (3, "\n"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1L AS piece", "'l' AS length", "2 AS rank")
    n, total = check_packing(packing.pack(df, WORD).collect(), rows)
    assert n <= -(-total // 4096) + 1
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_pack_the_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = check_packing(op4_packing(spark, sf).collect(), docs)
    assert n <= 1.02 * total / 4096 + 1


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_the_histogram(seed):
    r = random.Random(seed)
    hist = Counter(min(4096, 1 + int(r.expovariate(1 / 900))) for _ in range(20000))
    plan = packing.plan(hist)
    got = Counter()
    for n, lengths in plan:
        assert n > 0 and sum(lengths) <= 4096
        for x in lengths:
            got[x] += n
    assert got == hist
    assert sum(n for n, _ in plan) <= 1.01 * sum(k * v for k, v in hist.items()) / 4096 + 2


@pytest.mark.parametrize("hist", [{}, {1: 1}, {4096: 3}, {2500: 10, 1: 5}, {1: 100_000}, {2048: 7}])
def test_plan_edges(hist):
    plan = packing.plan(hist)
    least = sum(v for k, v in hist.items() if k > 2048) or -(-sum(k * v for k, v in hist.items()) // 4096)
    assert sum(n for n, _ in plan) == least


def test_ranges_cover_ranks():
    plan = [(3, (10, 10, 5)), (2, (5,))]
    assert packing.ranges(plan) == [(10, 0, 3, 0, 0), (10, 3, 6, 0, 10), (5, 0, 3, 0, 20), (5, 3, 5, 3, 0)]
