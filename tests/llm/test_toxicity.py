"""The positive-unlabelled classifier on held-out labels and on made texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import toxicity


def made(seed, n, toxic):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    return [" ".join(rng.sample(words, 60) + (["vile", "vilest", "rotten"] if toxic else [])).encode() for _ in range(n)]


def test_learns_from_positives_and_unlabelled():
    positive, clean = made(1, 120, True), made(2, 900, False)
    unlabelled = clean[:800] + made(3, 90, True)
    model = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    bad, good = model.margins(made(4, 100, True)), model.margins(made(5, 100, False))
    assert (bad[:, None] > good[None, :]).mean() > 0.99
    assert (model.scores(made(8, 50, True)) >= toxicity.THRESHOLD).mean() > 0.95
    assert (model.scores(made(9, 200, False)) < toxicity.THRESHOLD).mean() > 0.99


def test_without_positives_everything_is_clean():
    model = toxicity.fit_nnpu([], made(1, 20, False), 0.0)
    assert (model.scores([b"", b"vile"]) < 0.5).all()


def test_held_out_rows(spark):
    import zlib

    df = spark.range(200).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in df.collect())


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.op1_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    flagged = np.array([r.predicted for r in got]) == 1
    assert auc > 0.9 and y[flagged].mean() > 0.85 and flagged[y == 1].mean() > 0.5


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a.weights, a.bias) == (b.weights, b.bias)


def test_edges(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "idiot " * 50_000, 5), (3, "fine", 5), (None, "x", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (3, None, None), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.op1_toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert toxicity.op1_toxicity(docs.where("false"), labels.where("false")).count() == 0


def test_drop_keeps_clean_rows_of_a_repeated_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "vile", "a"), (1, "fine", "b"), (2, None, "c")], "doc_id long, text string, id string")
    bucket = toxicity.features(b"vile")[0]
    monkeypatch.setattr(toxicity, "train", lambda *a: toxicity.Model({bucket: 9.0}, -3.0))
    assert sorted(r.id for r in toxicity.drop_toxic(docs, docs).collect()) == ["b", "c"]


@pytest.mark.parametrize("text", [b"", b"\xff".decode("latin1").encode(), "ÄÖ ß İ".encode()])
def test_words(text):
    assert all(isinstance(w, bytes) for w in toxicity.words_of(text))


def test_whole_of_a_long_word_is_scored():
    """A text without blanks counts beyond its first bytes, in fitting and in scoring."""
    rng = random.Random(3)
    run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    positive = [(run(200) + "\u9f98\u9f97\u9f96" + run(20)).encode() for _ in range(60)]
    clean = [run(220).encode() for _ in range(300)]
    model = toxicity.fit_nnpu(positive, clean, 0.1)
    start = run(644)
    assert model.margins([(start + "\u9f98\u9f97\u9f96" + run(5)).encode()])[0] > model.margins([start.encode()])[0] + 1
    assert set(toxicity._counts([b"x" * 100 + b"vile"]).nonzero()[0]) == set(toxicity.features(b"x" * 100 + b"vile"))


def test_features_of_a_very_long_word_are_those_of_its_ngrams(monkeypatch):
    word = bytes(random.Random(5).choices(b"abcdef", k=500))
    want = set(toxicity.features(word))
    for size in (64, 100, 501):
        monkeypatch.setattr(toxicity, "GRAM_BYTES", size)
        assert set(toxicity.features(word)) == want


def test_words_end_at_blanks_and_marks_of_any_script():
    text = "a\u00a0b\u3000c\uff0cd\u3002e\u2014f\u0085g \u00e4\u0308h-\u0e01\u0e34"
    assert toxicity.words_of(text.encode()) == {w.encode() for w in [*"abcdefg", "\u00e4\u0308h", "\u0e01\u0e34"]}


def plain_risk(w, b, positive, unlabelled, prior):
    """The risk estimates by loops over texts, as lists of columns."""
    margin = lambda t: b + sum(w[c] for c in t) / max(1, len(t)) ** 0.5
    mean = lambda xs: sum(xs) / len(xs)
    loss = lambda s: float(np.log1p(np.exp(-s)))
    toxic = prior * mean([loss(margin(t)) for t in positive])
    clean = mean([loss(-margin(t)) for t in unlabelled]) - prior * mean([loss(-margin(t)) for t in positive])
    return toxic, clean


@pytest.mark.parametrize("bias", [-3.0, 0.0, -9.0])
def test_risk_and_gradient_against_brute_force(bias):
    """The corrected risk, and its gradient by differences; with a bias of -9 and positives that score high, the correction goes below zero and the step turns round."""
    rng = random.Random(6)
    positive = [rng.sample(range(6), rng.randint(0, 6)) for _ in range(9)]
    unlabelled = [rng.sample(range(6), rng.randint(0, 3)) for _ in range(14)]
    w = np.array([rng.uniform(-1, 2) for _ in range(6)])
    if bias == -9.0:
        w, unlabelled = 12 * np.abs(w), [t[:0] for t in unlabelled]
    prior = 0.2
    p, u = toxicity._entries(positive), toxicity._entries(unlabelled)
    toxic, clean, grad, by_bias = toxicity.risk(w, bias, p, u, prior)
    assert (toxic, clean) == pytest.approx(plain_risk(w, bias, positive, unlabelled, prior))
    # What is descended: the sum of both while the correction is not negative, else the negative of the correction.
    goal = (lambda w, b: sum(plain_risk(w, b, positive, unlabelled, prior))) if clean >= 0 else (lambda w, b: -plain_risk(w, b, positive, unlabelled, prior)[1])
    e = 1e-6
    for k in range(6):
        up, down = w.copy(), w.copy()
        up[k] += e
        down[k] -= e
        assert grad[k] == pytest.approx((goal(up, bias) - goal(down, bias)) / (2 * e), abs=1e-6)
    assert by_bias == pytest.approx((goal(w, bias + e) - goal(w, bias - e)) / (2 * e), abs=1e-6)
    assert (clean < 0) == (bias == -9.0)


def test_trained_on_executors_as_on_one_machine(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id not in held}
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id", F.lit("sample"))).collect()]
    want = toxicity.fit_nnpu([text[i] for i in order if known.get(i) == 1], [text[i] for i in order if i not in held], sum(known.values()) / len(known))
    got = toxicity.train(docs, labels)
    assert got.bias == pytest.approx(want.bias) and got.weights == pytest.approx(want.weights)


def test_bounds_of_the_samples_are_parameters(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.train(docs, labels, most_positive=3, most_unlabelled=40).weights != toxicity.train(docs, labels).weights


def test_ids_of_any_type(spark):
    """String ids that are no numbers; labels whose ids are of another type."""
    rows = [(f"a-{i}", "vile rotten words here" if i % 4 == 0 else f"fine day number {i} in town") for i in range(80)] + [(None, "vile"), ("x", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"a-{i}", 0, int(i % 4 == 0)) for i in range(40)], "doc_id string, quality int, toxic int")
    got = toxicity.op1_toxicity(docs, labels).collect()
    assert len(got) == 82 and {r.doc_id for r in got} == {i for i, _ in rows}
    numbers = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op1_toxicity(docs, numbers).count() == 82


def test_least_hashes(spark):
    from stratalog.llm.common import least

    keys = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.xxhash64("id")).alias("h"))
    want = sorted(r.h for r in keys.where("h is not null").collect())
    assert least(keys.unionByName(keys), 30) == want[29] and least(keys, 5000) == want[-1]
    assert least(keys.where("false"), 5) is None and least(keys, 0) is None
