"""The pipeline's stages against brute force on a small fixture."""

import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402
from stratalog.llm import toxicity  # noqa: E402
from stratalog.llm.queries import tokenizer_path  # noqa: E402
from test_decontaminate import words  # noqa: E402
from test_line_dedup import brute as line_counts  # noqa: E402
from test_simhash import brute as near  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs, docs.collect())]
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir).cache()
        out.append((name, docs, docs.collect()))
    return out


def test_columns_stay(stages):
    first = stages[0][1].columns
    assert all(df.columns == first for _, df, _ in stages[1:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    before, after = stages[0], stages[1]
    model = toxicity.train(before[1], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r, s in zip(before[2], model.scores([(r.text or "").encode() for r in before[2]]), strict=True) if s >= toxicity.THRESHOLD}
    assert bad and {r.doc_id for r in after[2]} == {r.doc_id for r in before[2]} - bad


def test_lines(stages):
    import hashlib

    want = line_counts([(r.doc_id, r.text) for r in stages[1][2]])
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in stages[2][2]} == {i: w[2] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in stages[2][2])


def test_one_of_each_group_stays(stages):
    want = near([(r.doc_id, r.text) for r in stages[2][2]])
    assert {r.doc_id for r in stages[3][2]} == {i for i, (_, c) in want.items() if i == c}


def has_passage(text, windows):
    own = words(text)
    return any(tuple(own[i : i + 13]) in windows for i in range(len(own) - 12))


def test_contaminated_go(spark, sf_dir, stages):
    windows = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (w := words(r.text)) for i in range(len(w) - 12)}
    assert {r.doc_id for r in stages[4][2]} == {r.doc_id for r in stages[3][2] if not has_passage(r.text, windows)}


def test_a_long_document_with_one_passage_goes(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    filler = " ".join(f"w{i}" for i in range(20_000))
    passage = " ".join(words(item)[:13])
    rows = [(1, f"{filler}\n{item}\n{filler}"), (2, filler), (3, f"{filler} {passage.upper()}, {filler}"), (4, " ".join(words(item)[:12]) + " " + filler), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, sf_dir).collect()) == [2, 4, 5, 6]


def test_packed_ids(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes() for r in stages[4][2]}
    got = {}
    for p in sorted(stages[5][2], key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] = got.get(p.doc_id, b"") + bytes(p.ids)
    assert got == want


def test_run(spark, sf_dir, stages):
    pieces = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, pieces)) == sorted((p.doc_id, p.start, zlib.crc32(bytes(p.ids))) for p in stages[5][2])


EDGES = "doc_id long, text string, lang string, source string, n_chars long, id string, h1 long, n_lines_before int, score double, `the.text` string"


def edge_rows():
    line = "A line of boilerplate that is longer than forty characters."
    long_ = " ".join(f"w{i % 5003}" for i in range(150_000))
    own = [(1, None), (2, ""), (3, " \n\t"), (4, long_), (5, long_), (None, "no id here at all, but five words and more"), (6, "own words six seven"), (6, "own words six seven"), (7, "\n".join([line, "seven has this to say"]))]
    own += [(10 + i, f"{line}\n" + " ".join(f"d{i}x{k}" for k in range(30))) for i in range(5)]
    return [(i, t, "en", None, None if t is None else len(t), "x", 9, 1, 0.5, "dot") for i, t in own]


def test_edge_cases_go_through_all_stages(spark, sf_dir):
    docs = spark.createDataFrame(edge_rows(), EDGES)
    out = {"documents": docs.collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, docs, sf_dir)
        assert df.schema.names == docs.schema.names, name
        docs = spark.createDataFrame(df.collect(), docs.schema)
        out[name] = docs.collect()
    assert len(out["toxicity"]) == len(out["documents"])
    assert [len(out[n]) for n in ("line_dedup", "simhash_near_dedup", "benchmark_decontamination")] == [14, 10, 10]
    text = {r.doc_id: r.text for r in out["line_dedup"]}
    assert text[1] is None and text[2] == "" and text[14].startswith("A line") and not text[10].startswith("A line") and text[7] == "seven has this to say"
    assert {r.doc_id for r in out["simhash_near_dedup"]} == {1, 4, 6, 7, None, 10, 11, 12, 13, 14}
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, sf_dir).collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) == 1 and sum(p.length for p in pieces if p.doc_id == 4) > 150_000
    # The same rows twice over, and none at all.
    twice = spark.createDataFrame(edge_rows() * 2, EDGES)
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, twice, sf_dir).count() == 10
    assert dict(corpus_pipeline.STAGES)["line_dedup"](spark, twice, sf_dir).count() == 28
    nothing = spark.createDataFrame([], EDGES)
    assert [f(spark, nothing, sf_dir).count() for _, f in corpus_pipeline.STAGES] == [0] * 5
