import hashlib
import random
import string
from collections import defaultdict

import duckdb

from tidewater.llm import lines as L

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(docs, least=10):
    where = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            where[key(x)].add((d, t))
    gone = {k for k, v in where.items() if k and len(v) >= least}
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in gone]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _docs():
    rng = random.Random(4)
    common = ["Ça VA", " ça va", "\tTHE END\r", "the end", "É", "é", "", " \x0b", " x", "x" * 300]
    docs = []
    for k in range(150):
        n = rng.choice([1, 3, 40, 200])
        docs.append((k, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(900)}" for _ in range(n))))
    docs += [(200 + k, docs[7][1]) for k in range(12)]
    return docs + [(300, None), (301, ""), (302, "\n\n"), (None, "the end\nnull id"), (5, docs[5][1]), (6, "the end")]


def test_report_equals_brute_force(spark):
    docs = _docs()
    df = spark.createDataFrame([(*d, "c", "w") for d in docs], "doc_id long, text string, pos string, keep_words string")
    got = sorted((tuple(r) for r in L.line_report(df).collect()), key=str)
    assert got == brute(docs)


def test_report_equals_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    want = sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({L.ORACLE_SQL})").fetchall())
    got = sorted(tuple(r) for r in L.line_report(spark.read.parquet(path)).collect())
    assert got == want


def test_drop_lines_keeps_first(spark):
    docs = [(k, f"Same line\nown {k}") for k in range(12)] + [(20, None)]
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in docs], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in L.drop_lines(df).collect()}
    assert out[0]["text"] == docs[0][1] and out[20]["text"] is None
    assert all(out[k]["text"] == f"own {k}" and out[k]["n_chars"] == len(f"own {k}") for k in range(1, 12))
    assert L.drop_lines(df).columns == df.columns and L.drop_lines(df.limit(0)).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = L.line_report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_code_and_sql_agree_on_documents(spark, tmp_path):
    docs = [(7, f"one line\nown {k}") for k in range(12)] + [(None, "one line\nno id"), (None, None), (8, "one line")]
    docs += [(20 + k, "two\none more") for k in range(8)] + [(None, "two"), (30, "two \n"), (30, "TWO")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    want = order(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({L.ORACLE_SQL})").fetchall())
    got = order(L.line_report(df).collect())
    assert got == want
    # twelve rows of one id are one document; eight ids, a null one and one id twice are ten
    assert all(r[2] == 0 for r in got if r[0] in (7, 8)) and all(r[2] == 1 for r in got if r[0] in (20, 27, 30))


def test_first_occurrences_stream_out_of_the_range_partitioned_order(spark):
    lines = spark.range(1000).selectExpr("id % 7 AS h1", "id % 7 AS h2", "id % 50 AS doc_id", "1L AS text_hash", "cast(id AS int) AS pos")
    df = L.first_in_documents(lines)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert df.count() == 350
