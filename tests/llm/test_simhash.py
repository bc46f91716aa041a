import random

import xxhash
from pyspark.sql import functions as F

from tidewater.llm import simhash as S


def test_hash_is_sparks_xxhash64(spark):
    got = spark.sql("select xxhash64('a b ç') h").first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_fingerprint_edges():
    assert S.fingerprint(None) == S.fingerprint("") == S.fingerprint(" \n\x0b") == 0
    assert S.fingerprint("One  Two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert S.fingerprint("A B C D") == S.fingerprint("a\tb\nc d")


def test_tree_finds_all_within_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(20)})
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v)) == [k for k, x in enumerate(values) if (x ^ v).bit_count() <= 3]


def _components(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_links_lose_none_when_shards_split(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for b in list(values)[:6]:
        v = b
        for _ in range(25):  # chains and clusters that share most blocks
            v ^= 1 << rng.randrange(20)
            values.add(v)
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = _components(sorted(values))
    for shard in (2048, 8):
        roots = {r["node"] % 2**64: r["root"] for r in S.components(S.links(df, shard=shard)).collect()}
        group = {v: roots.get(v, signed(v)) for v in values}
        for a in values:
            for b in values:
                assert (group[a] == group[b]) == (want[a] == want[b])


def _docs():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(25):
        body = [rng.choice(words) for _ in range(200)]
        docs.append((1000 - k, " ".join(body)))
        for j in range(3):
            body[rng.randrange(200)] = "edit"
            docs.append((3 * k + j, " ".join(body).upper()))
    return docs + [(500, None), (501, ""), (None, " "), (3, docs[1][1]), (700, "x")]


def test_whole_query_equals_all_pairs(spark):
    docs = _docs()
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, component_id string")
    order = lambda rows: sorted(rows, key=str)
    want = order(S.brute_near_duplicates(docs))
    assert len({x["component_id"] for x in want}) < len(docs) - 20
    assert order(r.asDict() for r in S.near_duplicates(df).collect()) == want
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({x["component_id"] for x in want})


def test_one_of_each_goes_by_rows_not_by_ids(spark):
    rng = random.Random(11)
    say = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(80))
    a, b, c, lone = say(), say(), say(), [say() for _ in range(20)]
    # null ids of unrelated texts; one id with two texts, of which one belongs to another id's component
    docs = [(None, t) for t in lone] + [(0, b), (3, a), (3, b), (7, c), (None, c), (7, c), (9, say()), (9, None), (None, "")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, component_id string")
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(None, t) for t in lone] + [(0, b), (3, a), (7, c), (9, docs[-3][1]), (9, None)], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
    assert S.components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
