import random

from tidewater.llm.decontaminate import brute_report, decontaminate, decontamination_report, matched


def _cases():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.choice([3, 13, 20, 40]))) for k in range(12)]
    items += [(90, "Solo"), (91, None), (92, ""), (93, items[0][1]), (94, "zu ß é")]
    docs = [(k, say(60)) for k in range(30)]
    for k in range(30, 60):
        body = items[rng.randrange(12)][1].split()
        docs.append((k, say(30) + "! " + ", ".join(body[: rng.randint(1, len(body))]).upper() + " -- " + say(rng.choice([3, 600]))))
    docs += [(70, None), (71, ""), (72, "solo"), (73, "Zu ß é solo solo"), (None, docs[40][1]), (30, docs[30][1])]
    return docs, items


def test_report_equals_every_window_tried(spark):
    docs, items = _cases()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    order = lambda rows: sorted(rows, key=str)
    want = order(brute_report(docs, items))
    assert any(x["contaminated"] for x in want)
    assert any(x["n_hit"] and not x["contaminated"] for x in want)
    assert order(r.asDict() for r in decontamination_report(d, b).collect()) == want
    # the same in several shards
    from pyspark.sql import functions as F

    many = matched(d, b, shard_bytes=300).select("doc_id", F.size("items").alias("n")).collect()
    assert order((r[0], r[1]) for r in many) == order((x["doc_id"], x["n_items"]) for x in want)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontamination_report(d, b).first()["n_hit"] == 0
    assert decontamination_report(d.limit(0), b).count() == 0


def test_decontaminate_cuts_or_drops(spark):
    item = " ".join(f"q{k}" for k in range(15))
    filler = " ".join(f"f{k}" for k in range(500))
    docs = [(1, f"{filler}. {item}! end", "x"), (2, f"start {item} end", "x"), (3, filler, "x"), (4, None, "x"), (5, "", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, row string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate(d, b).collect()}
    assert out.keys() == {1, 3, 4, 5}
    assert out[1]["text"] == f"{filler}. ! end"
    assert out[3]["text"] == filler and out[4]["text"] is None and out[5]["text"] == ""
    assert decontaminate(d, b).columns == d.columns
