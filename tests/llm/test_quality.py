"""Quality rules against SQL and plain code; the weak-label classifier against known votes and labels."""

import math
import random

import numpy as np
import pytest

from conftest import same_rows
from stratalog.llm import quality_classifier as qc
from stratalog.llm import quality_rules as qr


def test_rules_against_sql(spark, sf_dir):
    same_rows(qr.op2_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")), qr.ORACLE_SQL, sf_dir)


def repeated(words):
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(i, i + 8)}
    return len(hit)


def test_repeated_windows():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))] for _ in range(30)]
    texts += [[b"x"] * 8, [b"x"] * 9, [], [b"y"] * 30, [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"] * 2]
    assert qr.repeated(texts).tolist() == [repeated(t) for t in texts]


def test_statistics_and_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "ä b\x0bc\nä b\x0bc\n\nq #$"), (5, "one two " * 4000), (6, "#" * 50)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r)[1:] for r in qr.op2_quality_rules(df).collect()}
    assert got[1] == got[2] == got[3] == (0, 0, 0, 0, 0, True, False)
    assert got[4] == (8, 9, 2, 1, 0, True, False)
    assert got[5][0] == 8000 and got[5][4] == 8000 and got[5][5] and not got[5][6]
    assert got[6][2] == 50
    assert qr.op2_quality_rules(df.where("false")).count() == 0


def ordered_by(texts, rules=qr.RULES, given=()):
    found = [qr.profile(t, rules, given) for t in texts]
    return qr.order(np.array([w for w, _ in found]).reshape(-1, len(rules)), np.array([r for _, r in found], bool).reshape(-1, len(rules)))


def test_order_changes_cost_only():
    rng = random.Random(2)
    texts = [(" ".join(rng.choice(["word", "The", "x#", "!!", "LOUD"]) for _ in range(rng.randint(0, 120)))).encode() for _ in range(80)]
    for ordered in (list(range(len(qr.RULES))), list(range(len(qr.RULES)))[::-1], ordered_by(texts)):
        assert sorted(ordered) == list(range(len(qr.RULES)))
        for t in texts:
            k = qr.first_rejection(qr.Document(t), ordered)
            assert (k is not None) == any(qr.verdicts(t)) and (k is None or qr.verdicts(t)[k])


def test_cascade_stops_and_puts_cheap_rejections_first():
    ran = []
    slow = qr.Rule("slow", lambda d: ran.append("slow") or d.once("slow", 1000, bool))
    fast = qr.Rule("fast", lambda d: ran.append("fast") or b"bad" in d.text)
    ordered = ordered_by([b"bad", b"good", b"bad"], (slow, fast))
    assert ordered == [1, 0]
    ran.clear()
    assert qr.first_rejection(qr.Document(b"bad"), ordered, (slow, fast)) == 1 and ran == ["fast"]
    assert ordered_by([], (slow, fast)) == [0, 1]


def test_rejected_texts_are_spared_the_dear_statistics():
    """Rules over statistics that are there come first, and what they reject never pays for the others."""
    texts = [b"too short"] * 30 + [b" ".join(b"word%d" % (i + k) for k in range(60)) for i in range(30)]
    ordered = ordered_by(texts, given=tuple(qr.BASE))
    free = {"few_words", "word_length", "symbols", "repeated_lines", "repeated_windows"}
    assert {qr.RULES[k].name for k in ordered[:5]} == free
    d = qr.Document(b"too short")
    for f in qr.BASE.values():
        f(d)
    before = d.work
    assert qr.RULES[qr.first_rejection(d, ordered)].name == "few_words" and d.work == before
    assert not {"counts", "n_again", "n_bare", "n_shouting"} & set(d._kept)


def test_order_is_the_same_in_every_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = qr.estimate(docs)
    assert first == qr.estimate(docs.repartition(7)) and sorted(first) == list(range(len(qr.RULES)))
    by = lambda d: sorted(map(tuple, qr.judge(d).collect()))
    assert by(docs) == by(docs.repartition(5))


def test_em_finds_accuracies():
    """Votes drawn from labellers of known accuracy: the model finds them without labels."""
    rng = np.random.default_rng(3)
    accuracy = np.array([0.95, 0.8, 0.7, 0.6, 0.9])
    truth = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((4000, 5)) < 0.2] = qc.NONE
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = qc.fit_labels(patterns, count.astype(float))
    assert model.share == pytest.approx(0.7, abs=0.05)
    assert model.chances[1, :, qc.GOOD] == pytest.approx(accuracy, abs=0.06)
    assert model.posterior(np.full((1, 5), qc.NONE))[0] == pytest.approx(model.share)
    right = ((model.posterior(votes) > 0.5) == truth).mean()
    majority = (((votes == 1).sum(1) > (votes == 0).sum(1)) == truth).mean()
    assert right > 0.9 and right >= majority


def test_patterns_round_trip():
    for p in (0, 1, 3 ** len(qc.LABELLERS) - 1, 12345):
        assert qc.pattern(qc.unpack(p)) == p


def test_classifier_on_labels(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = qc.op4_quality_classifier(df).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)


def plain_labels(v, count, rounds):
    """The label model by loops, from its definition."""
    n, k = len(v), len(v[0])
    q = []
    for row in v:
        cast = [x for x in row if x != qc.NONE]
        q.append(min(max(sum(x == qc.GOOD for x in cast) / max(1, len(cast)), 0.05), 0.95) ** 2)
    for _ in range(rounds):
        chance = {}
        for side in (0, 1):
            weight = [count[i] * (q[i] if side else 1 - q[i]) for i in range(n)]
            for j in range(k):
                cast = {x: 1 + sum(w for w, row in zip(weight, v, strict=True) if row[j] == x) for x in (qc.BAD, qc.GOOD)}
                for x in cast:
                    chance[side, j, x] = cast[x] / sum(cast.values())
        share = sum(c * p for c, p in zip(count, q, strict=True)) / sum(count)
        q = []
        for row in v:
            good, bad = share, 1 - share
            for j, x in enumerate(row):
                if x != qc.NONE:
                    good, bad = good * chance[1, j, x], bad * chance[0, j, x]
            q.append(good / (good + bad))
    return q


def test_classifier_against_brute_force(spark, sf_dir):
    """Patterns, posteriors and scores of the query are those of plain code over the same texts."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    cast = {i: qc.votes(qc.measures(t)) for i, t in rows.items()}
    patterns = sorted({tuple(v) for v in cast.values()}, key=lambda v: qc.pattern(list(v)))
    count = [sum(tuple(v) == p for v in cast.values()) for p in patterns]
    # As many rounds as the operator takes until nothing moves.
    soft = dict(zip(patterns, plain_labels(patterns, count, qc.ROUNDS), strict=True))
    model, w, b = qc.train(df)
    got = {r.doc_id: r for r in qc.op4_quality_classifier(df).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        found = qc.features(t, qc.measures(t))
        margin = b + sum(w[x] for x in found) / max(1, len(found)) ** 0.5
        assert got[i].pattern == qc.pattern(cast[i])
        assert got[i].posterior == pytest.approx(soft[tuple(cast[i])], abs=1e-4)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    # Where the scorer stands, its loss on the soft labels falls no further along its own gradient.
    own = [qc.features(t, qc.measures(t)) for t in rows.values()]
    y = np.array([soft[tuple(v)] for v in cast.values()])
    loss = lambda scale: -np.mean([t * math.log(p) + (1 - t) * math.log(1 - p) for t, f in zip(y, own, strict=True) for p in [min(max(1 / (1 + math.exp(-scale * qc.margin(w, b, f))), 1e-9), 1 - 1e-9)]])
    assert loss(1.0) < loss(0.2) < loss(0.0)


def test_classifier_edges(spark):
    good = "The way to the house was long and the road was in the dark of the night. "
    rows = [(i, good * (1 + i % 4) + f"It was {i} in all.") for i in range(30)] + [(40, None), (41, ""), (42, "### $$$ " * 40), (43, "a" * 200_000), (41, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = qc.op4_quality_classifier(df).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    assert qc.op4_quality_classifier(df.where("false")).count() == 0
