import random
from collections import defaultdict

import corpus_pipeline as C
from tidewater.llm.decontaminate import brute_report, words_of
from tidewater.llm.simhash import brute_near_duplicates


def _corpus():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = say(30)
    docs = {k: f"{say(40)}.\n{say(60)}" for k in range(60)}
    for k in range(60, 70):  # toxic
        docs[k] = f"{say(20)}. you vile toad, {say(5)}. {say(20)}"
    for k in range(70, 75):  # leaks
        docs[k] = f"{say(50)} {item} {say(50)}"
    for k in range(75, 80):  # copies
        docs[k] = docs[k - 60]
    for k in range(80, 95):  # a repeated line
        docs[k] = f"Subscribe to our list\n{say(50)}"
    return docs, item


def test_each_stage_works_on_what_the_last_kept(spark, tmp_path):
    docs, item = _corpus()
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(60 <= k < 70)) for k in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out = stage(spark, docs_now, str(tmp_path))
        if name != "packing":
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs_now.collect()
    text = {name: {r["doc_id"]: r["text"] for r in rows} for name, rows in kept.items() if name != "packing"}
    assert text["toxicity"] == {k: t for k, t in docs.items() if not 60 <= k < 70}
    assert text["line_dedup"] == {k: t.removeprefix("Subscribe to our list\n") if k > 80 else t for k, t in text["toxicity"].items()}
    groups = defaultdict(list)
    for r in brute_near_duplicates(list(text["line_dedup"].items())):
        groups[r["component_id"]].append(r["doc_id"])
    assert text["near_dedup"] == {k: text["line_dedup"][k] for k in groups}
    assert not text["near_dedup"].keys() & set(range(75, 80))
    bad = {r["doc_id"] for r in brute_report(list(text["near_dedup"].items()), [(1, item)]) if r["contaminated"]}
    assert bad == set(range(70, 75))
    assert text["decontamination"] == {k: t for k, t in text["near_dedup"].items() if k not in bad}
    packed = kept["packing"]
    assert {r["doc_id"] for r in packed} == text["decontamination"].keys()
    assert all(r["length"] > len(words_of(text["decontamination"][r["doc_id"]])) for r in packed)
    whole = C.run(spark, str(tmp_path))
    same = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert same(whole.collect()) == same(packed)


def _stages(spark, tmp_path, rows, schema):
    """The rows after each stage, over a table that need not be clean."""
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, out = spark.createDataFrame(rows, schema), {}
    for name, stage in C.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = now.collect()
    return out


def test_nulls_empty_texts_and_repeated_rows(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    own = [say(40) for _ in range(30)]
    rows = [(k, t, "x", "y", "z") for k, t in enumerate(own)]
    rows += [(100, None, None, None, None), (None, say(50), "a", None, "c"), (None, say(50), "b", None, "c"), (3, own[3], "x", "y", "z"), (200, "", "", "", "")]
    schema = "doc_id long, text string, `_null` string, `gone_id` string, `_lines` string"
    out = _stages(spark, tmp_path, rows, schema)
    assert len(out["toxicity"]) == len(out["line_dedup"]) == len(rows)
    texts = [r["text"] for r in out["near_dedup"]]
    # null and empty texts have one fingerprint, so one of them stays; of rows alike one stays; rows without an id stay
    assert sum(not t for t in texts) == 1 and sorted(t for t in texts if t) == sorted({t for _, t, *_ in rows if t})
    assert {r["_null"] for r in out["decontamination"] if r["doc_id"] is None} == {"a", "b"}
    assert len({(r["doc_id"], r["ids_crc32"]) for r in out["packing"]}) == len(out["decontamination"])


def test_empty_table(spark, tmp_path):
    out = _stages(spark, tmp_path, [], "doc_id long, text string, n_chars long")
    assert all(rows == [] for rows in out.values())
