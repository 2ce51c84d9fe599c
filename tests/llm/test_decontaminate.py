"""Window hits against a direct search, and their SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from stratalog.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items):
    windows = []
    for name, text in items:
        w = words(text)
        windows += [(str(name), w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w and name is not None else []
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for name, x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(name)
        out[i] = (len(w), len(hit), len(found), dc.digest(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    if options:
        return {r.id: (r.n_words, r.n_hit, r["items"]) for r in dc.contamination(d, b, **options).collect()}
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.op10_decontaminate(d, b).collect()}


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "Of", "x1", "ä", "Émile", "b", "c", "d", "e", "f", "9"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 5, 12, 13, 14, 30]))) for i in range(25)] + [(30, None), (31, "the the"), (None, "a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    for i in range(30, 60):
        own = rng.choice(items[:25])[1]
        docs.append((i, f"{text(rng.randint(0, 20))}. {own.upper()}; {text(rng.randint(0, 300))}"))
    return [*docs, (70, None), (71, "-- ?"), (72, "")], items


def test_against_sql(spark, sf_dir):
    got = dc.op10_decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    same_rows(got, dc.ORACLE_SQL, sf_dir)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = sample(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_a_large_benchmark_is_joined(spark):
    """Above the bound the same rows come from joins, also where the filter lets nearly everything pass."""
    docs, items = sample(3)
    item = " ".join(f"w{i}" for i in range(20))
    docs += [(80 + i, "x " * 50 + item + " y" * (i % 2) + " x" * 50) for i in range(9)] + [(90, item), (90, item)]
    items += [(60, item), (61, item + " tail"), (60, "w3 w4 w5")]
    one = run(spark, docs, items, broadcast_bytes=1 << 20)
    for bits in (1 << 16, 1 << 20):
        assert run(spark, docs, items, broadcast_bytes=0, filter_bits=bits) == one
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(d, b.where("false"), broadcast_bytes=-1).where("n_hit > 0").count() == 0
    assert dc.contamination(d.where("false"), b, broadcast_bytes=0).count() == 0


def test_join_on_tables(spark, sf_dir):
    d, b = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    by = lambda n: sorted(map(str, dc.contamination(d, b, broadcast_bytes=n, filter_bits=1 << 20).collect()))
    assert by(0) == by(1 << 20)


def test_text_that_runs_on_into_the_next_row(spark):
    """A window is never made of two texts."""
    item = " ".join(f"w{i}" for i in range(13))
    docs = [(1, " ".join(f"w{i}" for i in range(7))), (2, " ".join(f"w{i}" for i in range(7, 13))), (3, item)]
    got = run(spark, docs, [(1, item)])
    assert [got[i][1] for i in (1, 2, 3)] == [0, 0, 13]


def test_both_ways_drop_the_same(spark, sf_dir):
    d, b = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc", F.lit(1)), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    b = b.unionByName(spark.createDataFrame([(900, "the and")], b.schema))
    by = lambda n: sorted(r.doc_id for r in dc.drop_contaminated(d, b, broadcast_bytes=n, filter_bits=1 << 20).collect())
    assert by(0) == by(1 << 20) and 0 < len(by(0)) < d.count()


def test_empty_tables_and_dropping(spark):
    d = spark.createDataFrame([(1, "a b c", "k"), (2, " ".join(f"q{i}" for i in range(40)), "l"), (2, "a b c", "m"), (None, "zz", "n")], "doc_id long, text string, id string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted(r.id for r in dc.drop_contaminated(d, b).collect()) == ["l", "n"]
    assert dc.drop_contaminated(d, b.where("false")).count() == 4
    more = b.unionByName(spark.createDataFrame([(i, f"zz{i} " * 20) for i in range(9)], b.schema))
    assert sorted(r.id for r in dc.drop_contaminated(d, more, broadcast_bytes=0, filter_bits=1 << 16).collect()) == ["l", "n"]
    assert dc.op10_decontaminate(d.where("false"), b).count() == 0


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = "x " * 300_000 + item + " y" * 300_000
    assert run(spark, [(1, text)], [(9, item)])[1][:3] == (600_020, 20, 1)
