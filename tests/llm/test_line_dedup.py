"""Line dedup against its definition in plain Python, and its SQL."""

import hashlib
import random
from collections import defaultdict

from conftest import same_rows
from stratalog.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(BLANKS).translate(FOLD)
            if len(k) >= 40:
                holders[k].add(i)
    shared = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if shared.get(x.strip(BLANKS).translate(FOLD), i) == i]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op5_line_dedup(df).collect()}


def test_against_sql(spark, sf_dir):
    same_rows(line_dedup.op5_line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")), line_dedup.ORACLE_SQL, sf_dir)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [f"Line {i} " + "äx"[i % 2] * (30 + i) for i in range(14)] + ["", "short", "\tA" + "b" * 38, "é" * 40, "É" * 40]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " ", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n"])))
    rows += [(100, None), (101, ""), (102, "\n"), (103, " " + "q" * 40)]
    assert run(spark, rows) == brute(rows)


def test_threshold_counts_documents_not_lines(spark):
    line = "x" * 40
    rows = [(i, "\n".join([line] * 9)) for i in range(4)]
    assert all(r[1] == 0 for r in run(spark, rows).values())
    got = run(spark, [*rows, (4, line), (5, "y")])
    assert [got[i][1] for i in range(6)] == [9, 9, 9, 9, 0, 0]


def test_39_code_points_stay(spark):
    assert all(r[1] == 0 for r in run(spark, [(i, " " * 9 + "ä" * 39) for i in range(8)]).values())


def test_long_text_extra_columns_and_nulls(spark):
    lines = [f"line {i} " + "z" * 40 for i in range(5000)]
    rows = [(i, "\n".join(lines), "a", 1) for i in range(5)] + [(None, lines[0], None, None), (7, None, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines_before string, __lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [got[i].n_lines_dropped for i in range(5)] == [5000, 5000, 5000, 5000, 0]
    assert got[None].n_lines_dropped == 1 and got[7].text is None and got[7].n_lines_before == 1
    assert got[4].text == "\n".join(lines)


def test_repeated_rows_and_empty_table(spark):
    line = "w" * 50
    df = spark.createDataFrame([(i, line) for i in range(5)] * 2, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([(i, int(i < 4)) for i in range(5)] * 2)
    assert line_dedup.op5_line_dedup(df.where("false")).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = line_dedup.op5_line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_rows_of_one_id_are_one_document(spark):
    """Four rows of one id and one of another are two documents, as in the SQL; five ids in ten rows are five."""
    line = "y" * 50
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    dropped = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.n_lines_dropped) for r in line_dedup.dedup_lines(df(rows)).collect())
    assert {n for _, _, n in dropped([(1, line)] * 4 + [(2, line)])} == {0}
    assert {n for _, _, n in dropped([(1, line), (1, line + "\nz"), (1, "q\n" + line), (2, line), (3, line), (4, line)])} == {0}
    assert dropped([(i, line) for i in (1, 2, 3, 4, None)] * 2) == sorted([(False, i, int(i < 4)) for i in (1, 2, 3, 4)] * 2 + [(True, 0, 1)] * 2)


def test_repeated_rows_against_sql(spark, tmp_path):
    """The SQL over the ids that have one row each agrees when other ids repeat."""
    import duckdb

    line = "A line that stands in many documents, %d and counting on"
    rows = [(i, "\n".join([line % (i % 3), "own %d" % i])) for i in range(12)] + [(50, line % 7)] * 4 + [(51, line % 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE_SQL).fetchall() if r[0] != 50}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op5_line_dedup(df).collect()}
    assert {i: r for i, r in got.items() if i != 50} == want and got[51][1] == 0 and got[50][1] == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "x" * 44, i) for i in range(6)], ["the.id", "the.text", "__k"]).withColumnRenamed("__k", "__drop")
    got = line_dedup.dedup_lines(df, "the.id", "the.text")
    assert got.columns == ["the.id", "the.text", "__drop", "n_lines_before", "n_lines_dropped"]
    assert sorted(r.n_lines_dropped for r in got.collect()) == [0, 1, 1, 1, 1, 1]
