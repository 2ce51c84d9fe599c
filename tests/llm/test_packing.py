"""Packed sequences hold every id once, in order, without gaps; windows are full."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from stratalog.llm import packing  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def unpacked(pieces):
    """Checks the sequences; returns the ids by document."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        docs[p.id].append(p)
    lengths = []
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0 and len(p.ids) == 4 * p.length
            at += p.length
        lengths.append(at)
    out = {}
    for i, own in docs.items():
        own.sort(key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at
            at += p.length
        assert {p.doc_tokens for p in own} == {at}
        out[i] = b"".join(bytes(p.ids) for p in own)
    return out, lengths


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    library = tokenizers.Tokenizer.from_file(PATH)
    want = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes() for r in df.collect()}
    got, lengths = unpacked(packing.pack(df, PATH).collect())
    assert got == want
    short = [n for n in lengths if n < 4096]
    assert max(lengths) == 4096 and all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


def test_query_digests_the_pieces(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in packing.op6_packing(df, PATH).collect() if r.doc_id == 2}
    assert got[2].doc_tokens == 1 and got[2].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())


def test_edges(spark):
    rows = [(1, ""), (2, None), (3, "word " * 4095), (4, "word " * 4096), (5, "word " * 20_000), (6, "x"), (None, "y z"), (7, "same text")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    got, lengths = unpacked(packing.pack(df, PATH, shard_tokens=6000).collect())
    assert {i: len(x) // 4 for i, x in got.items()} == {1: 1, 2: 1, 3: 4096, 4: 4097, 5: 20_001, 6: 2, None: 3, 7: 3}
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 3, "doc_id long, text string")
    pieces = packing.pack(df, PATH).collect()
    assert sum(p.length for p in pieces) == 15


@pytest.mark.parametrize("seed", range(5))
def test_fill(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 50, int(rng.integers(1, 64))).astype(np.uint16) for _ in range(int(rng.integers(0, 80)))]
    rows = packing.fill(docs, 64)
    seen = sorted((d, s + k) for row in rows for d, s, n in row for k in range(n))
    assert seen == [(d, k) for d, x in enumerate(docs) for k in range(len(x))]
    assert all(sum(n for *_, n in row) == 64 for row in rows[:-1])
    if rows:
        halves = packing._halved(rows[-1], 64)
        assert [p for h in halves for p in [sum(n for *_, n in h)] if p & (p - 1)] == []
        assert sorted((d, s + k) for row in halves for d, s, n in row for k in range(n)) == sorted((d, s + k) for d, s, n in rows[-1] for k in range(n))


def test_neighbours_share_a_window():
    """Of documents on two subjects, a window takes those of its seed's."""
    rng = random.Random(7)
    topic = lambda lo: np.array([rng.randrange(lo, lo + 40) for _ in range(16)], np.uint16)
    docs = [topic(100 if i % 2 else 500) for i in range(32)]
    rows = packing.fill(docs, 64)
    pure = sum(len({d % 2 for d, *_ in row}) == 1 for row in rows)
    assert pure >= len(rows) - 1


def test_bm25_scores():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3], [1, 1, 9], [4, 5, 6])]
    s = packing.InvertedIndex(docs).scores(0)
    n, df, avg = 3, 2, 3.0
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    assert s[2] == 0 and s[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (1 - 0.75 + 0.75 * 3 / avg)))


def test_related_documents_meet_among_many_shards(spark):
    """Copies far apart in the table, and texts of one subject, are dealt to one shard."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(2000)]
    subjects = [rng.sample(words, 40) for _ in range(60)]
    copies = [" ".join(rng.choices(subjects[i % 60], k=120)) for i in range(120)]
    df = spark.createDataFrame([(i, copies[i % 120]) for i in range(240)], "doc_id long, text string")
    shards = defaultdict(set)
    pieces = packing.pack(df, PATH, shard_tokens=4000).collect()
    for p in pieces:
        shards[p.id].add(p.sequence_id >> packing.SEQUENCE_BITS)
    assert len(set().union(*shards.values())) > 12
    assert sum(bool(shards[i] & shards[i + 120]) for i in range(120)) > 90
    assert sum(bool(shards[i] & shards[i + 60]) for i in range(60)) > 30


def test_one_group_of_copies_is_cut_into_shards(spark):
    df = spark.createDataFrame([(1, "the same text over and over " * 40)] * 400, "doc_id long, text string")
    sizes, tasks = defaultdict(int), set()
    for p in packing.pack(df, PATH, shard_tokens=3000).collect():
        sizes[p.sequence_id >> packing.SEQUENCE_BITS] += p.length
        tasks.add(p.sequence_id >> packing.SEQUENCE_BITS + packing.SHARD_BITS)
    assert len(sizes) > 20 and max(sizes.values()) < 3000 + 4096 and len(tasks) > 2 and sum(sizes.values()) == 400 * 241


def test_whole_windows_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "word " * 9000), (2, "a b"), (3, "word " * 4095)], "doc_id long, text string")
    df = packing.pack(df, PATH, shard_tokens=500)
    got, lengths = unpacked(df.collect())
    assert sorted(lengths, reverse=True)[:3] == [4096] * 3 and sum(p.sequence_id >= packing.WHOLE for p in df.collect()) == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan


def test_index_takes_frequencies_of_all_shards():
    docs = [np.array(x, np.uint16) for x in ([1, 2], [1, 3], [2, 3])]
    idf = np.array([0.0, 0.1, 5.0, 1.0])
    s = packing.InvertedIndex(docs, idf, 2.0).scores(0)
    assert s[2] == pytest.approx(5.0) and s[1] == pytest.approx(0.1)


def test_all_terms_of_a_seed_count():
    """A document that shares hundreds of a seed's tokens comes before those that share a few rarer ones."""
    seed, near = np.arange(1000, dtype=np.uint16), np.arange(100, 800, dtype=np.uint16)
    chance = [np.array([900 + i, 5000 + i], np.uint16) for i in range(30)]
    others = [np.arange(100, 800, 3, dtype=np.uint16), np.arange(101, 800, 3, dtype=np.uint16)]
    docs = [seed, near, *others, *chance]
    index = packing.InvertedIndex(docs)
    s = index.scores(0)
    mean = np.mean([len(d) for d in docs])
    for d in range(1, len(docs)):
        want = 0
        for t in set(docs[d].tolist()) & set(range(1000)):
            df = sum(t in x for x in docs)
            want += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        assert s[d] == pytest.approx(want)
    assert s[1:].argmax() == 0
    unused = np.arange(len(docs)) % 5 == 1
    index.drop(unused)
    assert index.scores(0)[unused] == pytest.approx(s[unused])
