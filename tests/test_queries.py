"""Every registered query with SQL gives DuckDB's rows."""

import compare
import pytest

from tidewater import queries as Q

SF = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare.differences(spark, con, name, Q.queries()[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(Q.queries().keys() - SQL.keys()))
def test_rows_only(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert not e.oracle_sql().keys() - e.queries().keys()


def test_entry_without_the_optional_parts():
    import __spark_entry__ as e

    def missing():
        raise ModuleNotFoundError("No module named 'corpus_pipeline'", name="corpus_pipeline")

    def other():
        raise ModuleNotFoundError("No module named 'x'", name="x")

    assert e._optional(missing) == {}
    with pytest.raises(ModuleNotFoundError):
        e._optional(other)


def test_profile_of_all_columns(spark, con):
    got = {r["name"]: r for r in Q.queries()["profile_lineitem_all"](spark, SF).collect()}
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert {n: r["data_type"] for n, r in got.items()} == dict(df.dtypes)
    for name, kind in df.dtypes:
        r = got[name]
        values = sorted(x for (x,) in con.execute(f"select {name} from lineitem").fetchall() if x is not None)
        assert r["null_count"] == con.execute(f"select count(*) - count({name}) from lineitem").fetchone()[0]
        if kind in ("string", "timestamp", "timestamp_ntz"):
            assert (r["min"], r["max"], r["p50"]) == (str(values[0]), str(values[-1]), "")
            continue
        assert (float(r["min"]), float(r["max"])) == (values[0], values[-1])
        for q, p in ((0.25, "p25"), (0.5, "p50"), (0.99, "p99")):
            at, slack = q * len(values), len(values) / 10_000 + 1
            assert values[max(0, int(at - slack) - 1)] <= float(r[p]) <= values[min(len(values) - 1, int(at + slack))]


@pytest.mark.parametrize("name", ["project_computed", "cast_double_colon", "scalar_array_pack"])
def test_whole_tables_are_read(spark, name):
    table = "lineitem" if name == "project_computed" else "orders"
    assert Q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
