import io
import json
import math
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewater import cli, output
from tidewater.errors import EngineError
from tidewater.functions import predict, strict, vector
from tidewater.operators.profile import profile_frame
from tidewater.plans import report
from tidewater.session import Session, SessionOptions
from tidewater.sources import datagen, ipc, parquet

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    return Session(spark)


# vectors


def test_distances(s):
    rows = s.sql("SELECT l2_distance(a, b) AS l, cosine_distance(a, b) AS c FROM (VALUES ([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [0.0, 0.0]), (NULL, [1.0, 2.0]), ([1.0, CAST(NULL AS DOUBLE)], [1.0, 1.0])) AS v(a, b)").collect()
    assert abs(rows[0]["l"] - math.sqrt(2)) < 1e-6 and abs(rows[0]["c"] - 1) < 1e-6
    assert rows[1]["l"] == 5 and math.isnan(rows[1]["c"])
    assert rows[2]["l"] is rows[2]["c"] is rows[3]["l"] is None
    with pytest.raises(Exception, match="widths differ"):
        s.collect("SELECT l2_distance([1.0], [1.0, 2.0])")
    with pytest.raises(ValueError, match="must not be empty"):
        vector.query_vector([])
    with pytest.raises(ValueError, match="unknown metric"):
        vector.distance("l1", F.lit(1), F.lit(1))


def test_nearest_equals_sql(s):
    s.register_parquet("embeddings", f"{DATA}/embeddings.parquet")
    q = [0.25 * (k % 5) for k in range(64)]
    a = s.table("embeddings").nearest("embedding", q, 5, ties=["vec_id"]).select("vec_id").collect()
    b = s.collect(f"SELECT vec_id FROM embeddings ORDER BY l2_distance(embedding, {q}), vec_id LIMIT 5")
    assert a == b
    assert "TakeOrderedAndProject" in s.table("embeddings").nearest("embedding", q, 5).df._jdf.queryExecution().toString()


# strict floats and sums

FLOATS = [float("nan"), -0.0, 0.0, float("inf"), float("-inf"), struct.unpack("<d", struct.pack("<Q", 0xFFF8000000000000))[0]]


def _bits(x):
    return struct.unpack("<Q", struct.pack("<d", x))[0]


def test_total_order(s):
    df = s.spark.createDataFrame(pa.table({"v": pa.array([*FLOATS, None])}))
    rows = strict.with_total_order(df, "v").orderBy(strict.ORDER).where("v is not null").select("v").toArrow()["v"].to_pylist()
    assert [_bits(x) for x in rows] == [_bits(FLOATS[k]) for k in (5, 4, 1, 2, 3, 0)]
    row = strict.with_total_order(df, "v").agg(strict.total_min("v").alias("a"), strict.total_max("v").alias("b")).toArrow().to_pylist()[0]
    assert _bits(row["a"]) == _bits(FLOATS[5]) and _bits(row["b"]) == _bits(FLOATS[0])
    below = df.where(strict.total_compare(F.col("v"), "<", float("-inf"))).count()
    equal = df.where(strict.total_compare(F.col("v"), "=", 0.0)).count()
    assert (below, equal) == (1, 2)


def test_wrapping_sum(s):
    df = s.spark.createDataFrame([(1, 2**63 - 2), (1, 2**63 - 2), (2, -(2**63)), (2, -1), (3, None)], "k int, x bigint")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(strict.wrapping_sum(F.col("x")).alias("s")).collect()}
    assert got == {1: -4, 2: 2**63 - 1, 3: None}


# tables, statements


def test_names_and_corrupt_files(s, tmp_path):
    good = f"{tmp_path}/good"
    s.spark.range(5).write.parquet(good)
    s.register_parquet("Trips", good)
    s.register_parquet('"Odd name"', good)
    assert s.collect('SELECT count(*) AS n FROM trips t JOIN "Odd name" o ON t.id = o.id')["n"].to_pylist() == [5]
    (tmp_path / "bad.parquet").write_bytes(b"nothing of the kind")
    with pytest.raises(EngineError) as e:
        s.register_parquet("bad", f"{tmp_path}/bad.parquet")
    assert e.value.kind == "format"
    with pytest.raises(EngineError) as e:
        s.register_parquet("none", f"{tmp_path}/none.parquet")
    assert e.value.kind == "io"
    with pytest.raises(EngineError) as e:
        s.sql("SELECT * FROM bad")
    assert e.value.kind == "plan"
    with pytest.raises(EngineError):
        SessionOptions(batch_size=0).check()


def test_copy_create_and_arrow(s, tmp_path):
    s.register_arrow("nums", pa.table({"a": [1, 2, None]}))
    assert s.sql(f"COPY (SELECT a * 2 AS b FROM nums) TO '{tmp_path}/out' STORED AS PARQUET").first()["count"] == 3
    s.sql(f"CREATE EXTERNAL TABLE back STORED AS PARQUET LOCATION '{tmp_path}/out'")
    s.sql("CREATE TABLE twice AS SELECT b FROM back WHERE b IS NOT NULL")
    assert sorted(s.collect("SELECT b FROM twice")["b"].to_pylist()) == [2, 4]
    assert s.collect("SELECT a FROM nums ORDER BY a DESC")["a"].to_pylist() == [None, 2, 1]


def test_write_options_refused_before_anything(s, tmp_path):
    for bad in ({"row_group_rows": 0}, {"bloom_fpp": 1.0}, {"compression": "rar"}):
        with pytest.raises(EngineError):
            parquet.write_parquet(s.spark.range(3), f"{tmp_path}/x", parquet.WriteOptions(**bad))
    assert not list(tmp_path.iterdir())
    parquet.write_parquet(s.spark.range(3), f"{tmp_path}/x")
    assert parquet.write_parquet(s.spark.range(7), f"{tmp_path}/x") == 7
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_pruning_leaves_few_rows(s, tmp_path):
    df = s.spark.range(200_000).coalesce(1).selectExpr("id", "id div 2000 AS k")
    parquet.write_parquet(df, f"{tmp_path}/t", parquet.WriteOptions(row_group_rows=2000, bloom_columns=["id"]))
    read = s.spark.read.parquet(f"{tmp_path}/t")
    assert parquet.rows_scanned(read.where("k = 42")) <= 0.1 * 200_000
    assert read.where("k = 42").count() == 2000


def test_nan_rows_stay_without_pruning(spark, tmp_path):
    pq.write_table(pa.table({"v": [1.0, 2.0, float("nan")]}), f"{tmp_path}/n.parquet")
    s = Session(spark, SessionOptions(pruning=False))
    s.register_parquet("n", f"{tmp_path}/n.parquet")
    assert s.collect("SELECT count(*) AS n FROM n WHERE v > 100.0")["n"].to_pylist() == [1]


def test_dashboard(s):
    s.register_arrow("d", pa.table({"k": [1, 2, 2], "v": [1.0, 2.0, 3.0]}))
    d = s.dashboard("SELECT k, sum(v) AS s FROM d GROUP BY k", ["d"])
    assert [n.tag for n in d.plan if n.tag] == ["VectorAggregate: group_by=[k], aggr=[SUM(v)]"]
    assert d.counters and [p.max for p in d.profiles["d"]] == ["2", "3.0"]


def test_ipc(s, tmp_path):
    path = f"{tmp_path}/t.arrow"
    assert ipc.write_ipc(s.spark.range(10).selectExpr("id", "cast(id as string) t"), path) == 10
    assert sorted(r["id"] for r in ipc.read_ipc(s.spark, path).collect()) == list(range(10))


# the demo table


def _split_mix(state):
    m = 2**64 - 1
    while True:
        state = (state + 0x9E3779B97F4A7C15) & m
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        yield z ^ (z >> 31)


def test_demo_table_is_a_function_of_its_seed(s):
    first = datagen.CHUNK_ROWS
    it = _split_mix(42 ^ (first * 0xA0761D6478BD642F & (2**64 - 1)))
    rows = datagen.chunk(first, 500, 42).to_pylist()
    for k, r in enumerate(rows):
        a, b, *e = (next(it) for _ in range(10))
        assert r["id"] == first + k and r["s"] == f"s{(first + k) % 13}"
        assert r["k"] == (None if a % 50 == 0 else (a >> 8) % 100)
        assert r["v"] == (None if b % 40 == 0 else (b >> 8) % 2**32 % 100 / 4)
        assert np.allclose(r["emb"], [x % 2000 / 100 - 10 for x in e], atol=1e-5)
    df = datagen.demo_table(s.spark, 70_000, special_floats=True)
    assert df.count() == 70_000
    v = [r["v"] for r in df.where("id < 96").orderBy("id").collect()][::16]
    assert [_bits(x) for x in v] == [_bits(x) for x in FLOATS]


# models


def _model_file(path, layers, meta):
    header, body = ({"__metadata__": meta} if meta else {}), b""
    for k, (w, b) in enumerate(layers):
        for name, t in ((f"{k}.weight", w), (f"{k}.bias", b)):
            raw = np.asarray(t, dtype="<f4").tobytes()
            header[name] = {"dtype": "F32", "shape": list(np.shape(t)), "data_offsets": [len(body), len(body) + len(raw)]}
            body += raw
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + body)
    return str(path)


def test_predict(s, tmp_path):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(5, 4)), rng.normal(size=5)), (rng.normal(size=(2, 5)), rng.normal(size=2))]
    path = _model_file(tmp_path / "m.safetensors", layers, {"any.activation": "relu"})
    s.register_frame("f", s.spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [1.0, None, 0.0, 0.0])], "id int, features array<float>"))
    got = {r["id"]: r["y"] for r in s.sql(f"SELECT id, predict('{path}', features) AS y FROM f").collect()}
    (w, b), (v, c) = layers
    want = np.maximum(np.array([1, 2, 3, 4]) @ w.T + b, 0) @ v.T + c
    assert np.allclose(got[1], want, atol=1e-4) and got[2] is None and got[3] is None
    one = s.sql(f"SELECT predict('{path}', features, 'relu')[2] AS y FROM f WHERE id = 1").first()["y"]
    assert abs(one - want[1]) < 1e-4
    with pytest.raises(EngineError, match="the query asks for"):
        s.sql(f"SELECT predict('{path}', features, 'tanh') FROM f")
    plain = _model_file(tmp_path / "p.safetensors", layers, None)
    with pytest.raises(EngineError, match="declares no activation"):
        s.sql(f"SELECT predict('{plain}', features) FROM f")
    data = (tmp_path / "p.safetensors").read_bytes()
    for broken in (b"", data[:20], data[:-8]):
        with pytest.raises(EngineError):
            predict.parse_model("x", broken, "relu")
    gap = _model_file(tmp_path / "g.safetensors", [*layers, layers[0]], {"activation": "none"})
    with pytest.raises(EngineError, match="takes 4"):
        predict.read_model(s.spark, gap)


# reports, output, command line


def test_report(s):
    s.register_parquet("lineitem", f"{DATA}/lineitem.parquet")
    s.register_parquet("orders", f"{DATA}/orders.parquet")
    tags = lambda q: [n.tag for n in report.nodes(s.sql(q)) if n.tag]
    notes = lambda q: " ".join(n.note for n in report.nodes(s.sql(q)) if n.note)
    assert tags("SELECT l_partkey FROM lineitem WHERE 2.0 < l_quantity AND l_orderkey >= 5")[0].startswith("VectorFilter: l_quantity > 2.0")
    assert tags("SELECT l_suppkey, sum(l_quantity), count(l_partkey) FROM lineitem GROUP BY l_suppkey") == ["VectorAggregate: group_by=[l_suppkey], aggr=[SUM(l_quantity), COUNT(l_partkey)]"]
    assert tags("SELECT l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey") == ["VectorHashJoin: join_type=Inner, on=[l_orderkey = o_orderkey]"]
    assert "is not a comparison" in notes("SELECT l_partkey FROM lineitem WHERE l_quantity <> 2 OR l_tax > 1")
    assert "LeftOuter join" in notes("SELECT count(*) AS n, l_suppkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey") or "exactly one" in notes("SELECT l_partkey FROM lineitem GROUP BY l_partkey, l_suppkey")
    assert "avg" in notes("SELECT l_suppkey, avg(l_quantity) FROM lineitem GROUP BY l_suppkey")
    assert "must be bigint" in notes("SELECT l_returnflag, sum(l_quantity) FROM lineitem GROUP BY l_returnflag")
    assert "placement notes" in s.explain("SELECT 1 AS x")
    counted = report.counters(s.sql("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey"))
    assert any("Scan" in c.operator and c.metrics.get("numOutputRows") for c in counted)


def test_profile(s):
    df = s.sql("SELECT CAST(x AS INT) AS i, CAST(x AS DECIMAL(10,2)) AS d, CAST(x AS STRING) AS t, map('a', x) AS m, x > 2 AS b FROM (VALUES (1), (2), (3), (NULL)) AS v(x)")
    p = {c.name: c for c in profile_frame(df)}
    assert (p["i"].min, p["i"].max, p["i"].null_count, p["i"].p50) == ("1", "3", 1, "2.0")
    assert (p["d"].min, p["t"].max, p["t"].p25) == ("1.00", "3", "")
    assert (p["m"].min, p["m"].null_count, p["b"].max) == ("", 0, "true")


def test_output(s):
    df = s.sql("SELECT 1 AS k, CAST(NULL AS DOUBLE) AS v, 'NaN'::double AS n")
    assert "".join(output.render(df, "json")) == '[{"k":1,"v":null,"n":"NaN"}]\n'
    assert "".join(output.render(df.limit(0), "json")) == "[]\n"
    assert "".join(output.render(df.limit(0), "csv")) == "k,v,n\r\n"
    nested = s.sql("SELECT named_struct('a', [1.5, CAST('Infinity' AS DOUBLE)]) AS s, 'x,\"y' AS t")
    assert "".join(output.render(nested, "json")) == '[{"s":{"a":[1.5,"Infinity"]},"t":"x,\\"y"}]\n'
    assert "".join(output.render(nested, "csv")).endswith('"x,""y"\r\n')
    out = io.StringIO()
    output.print_rows(df, "table", out)
    assert out.getvalue().splitlines()[1] == "| k | v | n   |"


def test_command_line(spark, capsys, tmp_path, monkeypatch):
    monkeypatch.setattr(Session, "local", classmethod(lambda cls, *a, **k: cls(spark, a[1] if len(a) > 1 else None)))
    assert cli.main(["gen-data", "--out", f"{tmp_path}/t", "--rows", "1000"]) == 0
    assert cli.main(["sql", "-q", "SELECT count(*) AS n, count(k) AS k FROM T", "--table", f"T={tmp_path}/t", "--output", "csv"]) == 0
    text = capsys.readouterr().out
    assert "1000 rows" in text and "n,k\r\n1000," in text
    assert cli.main(["profile", "--table", f"T={tmp_path}/t", "--output", "json"]) == 0
    assert {x["name"] for x in json.loads(capsys.readouterr().out)} == {"id", "k", "v", "s", "emb"}
    assert cli.main(["explain", "-q", "SELECT id FROM t WHERE k = 4", "--table", f"t={tmp_path}/t"]) == 0
    assert "VectorFilter: k = 4" in capsys.readouterr().out
    assert cli.main(["sql", "-q", "SELECT 1", "--table", "broken"]) == 1


def test_frame_verbs_equal_sql(s):
    s.register_parquet("lineitem", f"{DATA}/lineitem.parquet")
    a = s.table("lineitem").filter(F.col("l_quantity") > 30).aggregate(["l_suppkey"], [F.count("*").alias("n")]).sort("l_suppkey").limit(4).collect()
    assert a == s.collect("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 4")
    t = s.table("lineitem").select("l_orderkey", "l_linenumber")
    both = t.alias("x").join(t.alias("y"), "x.l_orderkey", "y.l_orderkey")
    assert both.df.columns == ["l_orderkey", "l_linenumber"] * 2 and t.union(t).distinct().collect().num_rows <= t.collect().num_rows


def test_profile_of_a_struct_with_a_map(s):
    p = profile_frame(s.sql("SELECT named_struct('m', map('a', 1)) AS s, [named_struct('x', 2)] AS a, [map('a', 1)] AS n"))
    assert [(c.min, c.null_count) for c in p] == [("", 0), ("[{2}]", 0), ("", 0)]
    assert profile_frame(s.spark.range(1).select()) == []


def test_all_reasons_are_named(s):
    s.register_parquet("lineitem", f"{DATA}/lineitem.parquet")
    note = next(n.note for n in report.nodes(s.sql("SELECT l_returnflag, l_linestatus, avg(l_tax), count(DISTINCT l_suppkey) FROM lineitem GROUP BY l_returnflag, l_linestatus")) if n.note)
    assert all(code in note for code in ("[count]", "[type]", "[function]"))
    note = next(n.note for n in report.nodes(s.sql("SELECT l_tax FROM lineitem WHERE l_tax = l_discount AND l_linenumber > 3")) if n.note)
    assert "[shape]" in note and "[type]" in note


def test_log_line(s, caplog):
    with caplog.at_level("INFO", logger="tidewater"):
        s.collect("SELECT value FROM generate_series(1, 3) WHERE value > 1")
    assert "mode=embedded rows=2 batches=" in caplog.text and "operators=" in caplog.text


def test_file_broken_after_registration(s, tmp_path):
    pq.write_table(pa.table({"a": list(range(1000))}), tmp_path / "x.parquet")
    s.register_parquet("broken_later", str(tmp_path / "x.parquet"))
    data = (tmp_path / "x.parquet").read_bytes()
    (tmp_path / "x.parquet").write_bytes(data[: len(data) // 2])
    with pytest.raises(EngineError) as e:
        s.collect("SELECT sum(a) AS n FROM broken_later")
    assert e.value.kind == "format"


def test_tables_of_other_formats(s, tmp_path):
    (tmp_path / "c.csv").write_text("k,v\n1,2.5\n2,x y\n")
    (tmp_path / "j.json").write_text('{"k": 1, "l": [1, 2]}\n{"k": 3}\n')
    s.sql(f"CREATE EXTERNAL TABLE c STORED AS CSV LOCATION '{tmp_path}/c.csv'")
    s.sql(f"CREATE EXTERNAL TABLE j STORED AS JSON LOCATION '{tmp_path}/j.json'")
    assert s.collect("SELECT c.k + 1 AS n, v, l[2] AS e FROM c LEFT JOIN j ON c.k = j.k ORDER BY c.k").to_pylist() == [{"n": 2, "v": "2.5", "e": 2}, {"n": 3, "v": "x y", "e": None}]


def test_created_table_is_a_snapshot(s, tmp_path):
    s.spark.range(4).write.parquet(f"{tmp_path}/t")
    s.register_parquet("t4", f"{tmp_path}/t")
    s.sql("CREATE TABLE kept4 AS SELECT id FROM t4")
    s.spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert s.sql("SELECT count(*) AS n FROM kept4").first()["n"] == 4


def test_written_again_keeps_the_old_until_the_new_is_there(s, tmp_path):
    parquet.write_parquet(s.spark.range(3), f"{tmp_path}/x")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        parquet.write_parquet(s.sql("SELECT 1 / (value - 1) AS y FROM generate_series(0, 2)"), f"{tmp_path}/x")
    assert s.spark.read.parquet(f"{tmp_path}/x").count() == 3


def test_scan_summary(s, tmp_path):
    parquet.write_parquet(s.spark.range(1000), f"{tmp_path}/x")
    found = parquet.scan_summary(s.spark.read.parquet(f"{tmp_path}/x").where("id >= 0"))
    assert found.rows == 1000 and found.files >= 1 and found.bytes > 0


@pytest.mark.parametrize("name", sorted(predict.ACTIVATIONS))
def test_activations(s, tmp_path, name):
    layers = [(np.eye(3), np.zeros(3)), (np.eye(3), np.zeros(3))]
    path = _model_file(tmp_path / "a.safetensors", layers, {"activation": name})
    x = [-1.5, 0.0, 2.0]
    got = s.sql(f"SELECT predict('{path}', [{', '.join(f'CAST({v} AS FLOAT)' for v in x)}]) AS y").first()["y"]
    plain = {"relu": lambda v: max(v, 0), "gelu": lambda v: v * 0.5 * (1 + math.erf(v / math.sqrt(2))), "sigmoid": lambda v: 1 / (1 + math.exp(-v)), "tanh": math.tanh, "none": lambda v: v}[name]
    assert np.allclose(got, [plain(v) for v in x], atol=1e-6)


def test_strict_and_plain_sums(spark, s):
    rows = "(VALUES (9223372036854775807, 0.5::double), (1, '-0.0'::double), (5, '0.0'::double)) AS v(x, y)"
    with pytest.raises(EngineError, match="OVERFLOW"):
        s.collect(f"SELECT sum(x) AS n FROM {rows}")
    strict_ = Session(spark, SessionOptions(strict=True))
    got = strict_.collect(f"SELECT sum(x) AS n, sum(x) FILTER (WHERE y > 0) AS f, min(y) AS lo FROM {rows}").to_pylist()[0]
    assert (got["n"], got["f"], _bits(got["lo"])) == (-(2**63) + 5, 2**63 - 1, _bits(-0.0))


def test_division_by_types(s):
    got = s.collect("WITH h AS (SELECT value / 2 AS q, value AS v FROM generate_series(1, 5)) SELECT sum(q) AS a, max(v) / 2 / 2 AS b, (SELECT max(v) / 3 FROM h) AS c, sum(v) / 2.0 AS d, 7::double / 2 AS e, '1/2' AS f FROM h").to_pylist()[0]
    assert (got["a"], got["b"], got["c"], float(got["d"]), got["e"], got["f"]) == (6, 1, 1, 7.5, 3.5, "1/2")


def test_casts_of_fractions_round(s):
    rows = "(VALUES (0.5D), (1.5D), (6999.6D), (-2.5D)) AS v(x)"
    got = s.collect(f"SELECT CAST(x AS BIGINT) AS a, x::int AS b, TRY_CAST(x * 1e12 AS INT) AS c, CAST(CAST(x AS DECIMAL(6,1)) AS SMALLINT) AS d, CAST(x AS BIGINT) / 1000 AS e, bigint(x) AS f FROM {rows}").to_pylist()
    assert [tuple(r.values()) for r in got] == [(0, 0, None, 1, 0, 0), (2, 2, None, 2, 0, 1), (7000, 7000, None, 7000, 7, 6999), (-2, -2, None, -3, 0, -2)]
    assert s.collect("SELECT CAST(9007199254740993 AS BIGINT) AS a, CAST('7' AS INT) AS b, to_timestamp(1.7) = to_timestamp(1) AS c").to_pylist() == [{"a": 9007199254740993, "b": 7, "c": True}]
    # the analyser reads the ORDER BY as the column
    got = s.collect(f"SELECT CAST(x AS INT) AS k, count(*) AS n FROM {rows} GROUP BY CAST(x AS INT) HAVING CAST(x AS INT) > -2 ORDER BY cast(x AS INT) DESC").to_pylist()
    assert [tuple(r.values()) for r in got] == [(7000, 1), (2, 1), (0, 1)]
    got = s.collect("SELECT a / 2 AS q, d * a / 2 AS f, (d)::int AS g, abs(d)::int AS h, d::int AS i FROM (VALUES (3, -0.7D)) AS v(a, d) ORDER BY d::int").to_pylist()[0]
    assert tuple(got.values()) == (1, -1.0499999999999998, -1, 1, -1)


# put together from peers; RANGE frames and those over ranks
NEAR = [("CURRENT ROW", "1 FOLLOWING"), ("1 PRECEDING", "CURRENT ROW"), ("1 PRECEDING", "2 FOLLOWING"), ("4 PRECEDING", "0 FOLLOWING")]
FAR = [("UNBOUNDED PRECEDING", "CURRENT ROW"), ("CURRENT ROW", "UNBOUNDED FOLLOWING"), ("0 PRECEDING", "CURRENT ROW"), ("UNBOUNDED PRECEDING", "2 FOLLOWING"), ("3 PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "2 FOLLOWING"), ("2 PRECEDING", "4 FOLLOWING")]


def test_groups_frames_equal_duckdb(s):
    rng, n = np.random.default_rng(7), 300
    maybe = lambda values: [None if x < 0.15 else v for x, v in zip(rng.random(n), values.tolist(), strict=True)]
    t = pa.table({"id": range(n), "p": maybe(rng.integers(0, 4, n)), "k": maybe(rng.integers(0, 30, n)), "d": maybe(rng.integers(0, 3, n) / 2), "x": maybe(rng.integers(-50, 50, n))})
    s.register_arrow("peers", t)
    con = duckdb.connect()
    con.register("peers", t)
    # k = 3 has nulls only
    calls = ["sum(x)", "count(*)", "count(v.x)", "min(d)", "max(x)", "sum(CASE WHEN k <> 3 THEN d END)"]
    first, *windows = ["PARTITION BY p ORDER BY k NULLS LAST", "PARTITION BY v.p ORDER BY k DESC NULLS FIRST, d NULLS LAST", "ORDER BY d NULLS FIRST", "PARTITION BY p ORDER BY k % 7 NULLS LAST"]
    tried = [(calls, first, NEAR), (["sum(x)"], first, FAR), (["avg(x)"], first, NEAR), (["sum(CAST(x AS DECIMAL(12,2)))"], first, NEAR), *((["sum(x)", "count(v.x)"], w, NEAR[1:3] + FAR[:3]) for w in windows if "%" not in w), (["sum(x)"], windows[-1], NEAR)]
    for some, w, frames in tried:
        fields = [f"{call} OVER ({w} GROUPS BETWEEN {a} AND {b})" for call in some for a, b in frames]
        text = f"SELECT id, {', '.join(f'{f} AS f{k}' for k, f in enumerate(fields))}, row_number() OVER (ORDER BY id) AS r FROM peers AS v WHERE id <> 5"
        ours, theirs = ([tuple(r) for r in q] for q in (s.sql(text).collect(), con.execute(text).fetchall()))
        assert sorted(ours, key=lambda r: r[0]) == sorted(theirs, key=lambda r: r[0]), text


def test_groups_frame_sorts_once(s):
    s.register_parquet("lineitem", f"{DATA}/lineitem.parquet")
    call = "OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN {} PRECEDING AND 1 FOLLOWING) AS s FROM lineitem"
    sorts = lambda text: s.sql(f"SELECT l_orderkey, {text}")._jdf.queryExecution().executedPlan().toString().count("- Sort [")
    assert sorts("sum(l_quantity) " + call.format(1)) == sorts("count(*) " + call.format(2)) == 1
    assert sorts("sum(l_quantity) " + call.format(50)) == 2
    assert s.sql("SELECT *, sum(l_tax) " + call.format(1)).columns == [*s.table("lineitem").df.columns, "s"]
    # a decimal's sum of sums would be wider
    kind = s.sql("SELECT sum(CAST(l_tax AS DECIMAL(9,2))) " + call.format(1)).schema[0].dataType.simpleString()
    assert kind == "decimal(19,2)"


def test_costly_arguments_are_read_once(s):
    from tidewater.plans.dialect import to_spark

    assert to_spark("SELECT array_slice(f(a), -2, -1) FROM t").count("f(a)") == 1
    assert to_spark("SELECT l2_distance(f(a), b) FROM t").count("f(a)") == 1
    assert s.collect("SELECT trunc(1.9 + 1) AS t, gcd(3 * 4, 9 + 9) AS g").to_pylist() == [{"t": 2.0, "g": 6}]


def test_commands_run_once(s):
    s.sql("CREATE TEMPORARY VIEW halves AS SELECT value / 2.0 AS h FROM range(0, 3)")
    assert s.collect("SELECT sum(h) AS n FROM halves").num_rows == 1
    s.sql("DROP VIEW halves")
