"""The registered queries over the whole small tables, held to brute force."""

import hashlib

import pytest

from tidewater.llm import decontaminate, pii, queries, simhash, suffix_dedup

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op8(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    df = queries.op8_benchmark_decontamination(spark, SF)
    want = decontaminate.brute_report(docs, items)
    assert sum(x["contaminated"] for x in want) > 5
    assert _rows(df) == sorted((tuple(x[c] for c in df.columns) for x in want), key=str)


def test_op9(spark, docs):
    df = queries.op9_simhash_near_duplicates(spark, SF)
    assert _rows(df) == sorted((tuple(x[c] for c in df.columns) for x in simhash.brute_near_duplicates(docs)), key=str)


def test_op10(spark, docs):
    want = suffix_dedup.brute_report(docs)
    assert sum(x[2] for x in want) > 100_000
    assert _rows(queries.op10_suffix_dedup(spark, SF)) == sorted(want, key=str)


def test_op5(spark, docs):
    from test_pii import base_spans

    want = []
    for d, t in docs:
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base_spans(t))
        want.append((d, hashlib.sha256(joined.encode()).hexdigest()))
    assert _rows(queries.op5_personal_data(spark, SF).select("doc_id", "base_sha256")) == sorted(want, key=str)
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_op2(spark, docs):
    from tidewater.llm import edit_embedding as E

    order = sorted(docs)
    changed = [hashlib.sha256(E.edited(t, u).encode()).hexdigest() for (_, t), (_, u) in zip(order, order[1:] + order[:1], strict=True)]
    rows = {r["doc_id"]: r for r in queries.op2_edit_fingerprints(spark, SF).collect()}
    assert [rows[d]["edited_sha256"] for d, _ in order] == changed
    near = sum(rows[d]["near_edited"] > rows[d]["near_next"] for d, t in order if len(t) > 100)
    assert near >= 0.97 * sum(len(t) > 100 for _, t in order)
