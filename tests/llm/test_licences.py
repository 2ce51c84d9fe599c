"""Licence notices against SQL and a plain Dice coefficient."""

import re

from conftest import same_rows
from stratalog.llm import licences


def test_against_sql(spark, sf_dir):
    same_rows(licences.op7_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")), licences.ORACLE_SQL, sf_dir)


def grams(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], strict=False))


def test_against_plain_dice(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    texts = [
        "Released under the MIT License.", "released UNDER the mit-license", "Released under the MIT License today", "Released under a License.", "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose here.",
        mit, mit.replace("free of charge", "for nothing"), mit[: len(mit) // 3], "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)), f"Title here\n\n{mit}\n\nThe end of it.", "", "word", "the the the the the",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.best_dice) for r in licences.op7_licences(df).collect()}
    for i, text in enumerate(texts):
        units = {*text.split("\n"), *re.split(r"\n *\n\s*", text), text}
        best = {}
        for u in units:
            scores = [(2 * len(grams(u) & grams(t)) / (len(grams(u)) + len(grams(t))), n) for n, t in licences.TEMPLATES if grams(u)]
            top = max(scores, key=lambda s: s[0], default=(0, ""))
            if top[0] >= 0.8:
                best[min(n for s, n in scores if s == top[0])] = max(top[0], best.get(top[1], 0))
        assert got[i] == (",".join(sorted(best)), round(max(best.values(), default=0.0), 6)), text[:60]


def test_edges(spark):
    rows = [(1, None), (2, "Released under the MIT License.\n" * 2000), (2, "x"), (None, "Released under the MIT License."), (4, "a b " * 100_000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, licence string")
    got = licences.scan_licences(df).collect()
    assert sorted((r.id or 0, r.licence) for r in got) == [(0, "MIT"), (2, "MIT"), (2, "MIT")]  # of id 2, the line and the whole text
    assert licences.op7_licences(df).count() == 5
    assert licences.op7_licences(df.where("false")).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = licences.op7_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
