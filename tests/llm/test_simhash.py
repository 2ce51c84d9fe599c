"""Fingerprints bit by bit, links against all pairs, and components against a plain search."""

import random

import numpy as np
import pytest
import xxhash

from stratalog.llm import graph, simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def groups(nodes, edges):
    """The least node that each node reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)
    comp = groups(ids, [(ids[x], ids[y]) for x, y in zip(a, b, strict=True) if x < y])
    return {i: (f"{prints[i]:016x}", comp[i]) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(df).collect()}


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_edge_texts(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (3, ""), (4, " \n\t"), (6, "One"), (7, "one"), (8, "one two"), (9, "ONE\x0btwo"), (10, "a b c"), (11, "a b c d"), (12, "ä b c"), (13, long_), (14, long_ + " end")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[5] == got[4] == ("0" * 16, 3)


def test_fingerprint_sums_over_many_shingles():
    text = b" ".join(b"x%d" % (i % 5) for i in range(2000))
    assert int(simhash.fingerprints([b"", text, b"q"])[1]) == fingerprint(text.decode())


def linked_groups(fp, run):
    label = simhash.linked(fp, run)
    return label


@pytest.mark.parametrize("seed", range(6))
def test_links_within_nodes(seed):
    rng = np.random.default_rng(seed)
    fp, run = [], []
    for r in range(12):
        center = rng.integers(0, 2**63, dtype=np.uint64)
        own = {int(center)}
        for _ in range(int(rng.integers(0, 120))):
            x = rng.choice(list(own)) if rng.random() < 0.8 else int(center)
            for b in rng.integers(0, 24, int(rng.integers(1, 5))):
                x = int(x) ^ (1 << int(b))
            own.add(int(x))
        fp += sorted(own)
        run += [r] * len(own)
    fp, run = np.array(fp, np.uint64), np.array(run)
    order = np.lexsort((simhash.gray_rank(fp), run))
    fp, run = fp[order], run[order]
    label = simhash.linked(fp, run)
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2) & (run[:, None] == run[None, :])
    a, b = np.nonzero(near)
    assert label.tolist() == list(groups(range(len(fp)), list(zip(a.tolist(), b.tolist(), strict=True))).values())


def test_gray_neighbours_differ_in_one_bit():
    codes = np.array([i ^ i >> 1 for i in range(64)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


def test_masks_meet_all_pairs_within_two_bits():
    rng = random.Random(2)
    masks = [m & (2**64 - 1) for m in simhash._masks(list(range(64)))]
    assert len(masks) == 10
    for _ in range(300):
        d = sum(1 << b for b in rng.sample(range(64), 2))
        assert any(d & m == 0 for m in masks)
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        lower = [s & (2**64 - 1) for s in simhash._masks(free)]
        assert all(len(free) - s.bit_count() <= 11 for s in lower)
        for _ in range(50):
            d = sum(1 << b for b in rng.sample(free, 2))
            assert any(d & s == 0 for s in lower)


def test_large_nodes_are_factored(spark, monkeypatch):
    """Links are the same when every node is factored once more."""
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(5)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**63 - 1) for b in base for _ in range(40)}
    rows = [(p, i) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "fp long, doc long")
    want = groups([i for _, i in rows], [(i, j) for p, i in rows for q, j in rows if i < j and (p ^ q).bit_count() <= 2])
    for limit in (4096, 2):
        monkeypatch.setattr(simhash, "NODE_ROWS", limit)
        edges = [(r.u, r.v) for r in simhash.link_fingerprints(df).collect()]
        assert groups([i for _, i in rows], edges) == want


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(300, 340)]
    star = [(500, i) for i in range(501, 540)]
    noise = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    edges = [*chain, *star, *noise, (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(df, "a", "b").collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == groups(nodes, [e for e in edges if e[0] != e[1]])
    assert graph.components(df.where("false"), "a", "b").count() == 0


def test_keep_one_keeps_columns_and_one_row_of_a_group(spark):
    rows = [(2, "a b c d", "x", 1), (1, "a b c d", "y", 2), (3, "q r s", "z", 3), (3, "q r s", "z", 3), (3, "q r s", "w", None), (None, "t u v w", "n", 4), (None, "t u v w", "n", 4), (None, "a b c d", "o", 5), (7, None, "e", 6), (6, "", "f", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, h1 int")
    got = sorted(r.component for r in simhash.keep_one(df).collect())
    assert len(got) == 4 and {"y", "n", "f"} < set(got) and set(got) - {"y", "n", "f"} <= {"z", "w"}
    assert simhash.op8_simhash(df.where("false").select("doc_id", "text")).count() == 0
    assert simhash.keep_one(df.where("false")).count() == 0


def test_ids_of_any_type(spark):
    rows = [("b-2", "a b c d"), ("a-1", "a b c d"), ("c", "q r s t"), (None, "q r s t"), (None, "lone x y z")]
    got = {(r.doc_id, r.component_id) for r in simhash.op8_simhash(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b-2", "a-1"), ("a-1", "a-1"), ("c", "c"), (None, "c"), (None, None)}


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d"), (1, "q r s t"), (2, "q r s t"), (0, "a b c d")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.op8_simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1)]
