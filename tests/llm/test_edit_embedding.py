import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import edit_embedding as E


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.integers(0, 8))
def test_edit_distance(a, b, most):
    d = _levenshtein(a, b)
    assert E.edit_distance(a, b, most) == (d if d <= most else None)


def _plain_walk(text, steps):
    """The walk of one text, a step at a time."""
    moves, classes, out, at = E._moves(), E._classes(text).tolist() + [0], [], 0
    for t in range(int(steps.max()) + 1):
        c = classes[at]
        out += [c] * int((steps == t).sum())
        at += int(moves[t % E.PERIOD, c])
    return out


def test_walk_equals_a_plain_one():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdéü 日") for _ in range(n)) for n in (0, 1, 15, 16, 700, 720, 5000)]
    for text, (scale, own, wide) in zip(texts, E.Embedder().written(texts), strict=True):
        assert own.tolist() == _plain_walk(text, E.sample_steps(scale))
        assert wide.tolist() == _plain_walk(text, E.sample_steps(scale + 1))


def test_likeness_follows_the_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(4000))
    e = E.Embedder()
    base, far = e.fingerprints([text, "".join(rng.choice("etaoin shrdlu") for _ in range(4000))])
    last = 1.0
    for edits in (2, 20, 200):
        t = list(text)
        for _ in range(edits):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yz"])
        now = E.likeness(base, e.fingerprints(["".join(t)])[0])
        assert now < last
        last = now
    assert E.likeness(base, far) < 0.3 < last and E.likeness(base, base) == 1.0


def _docs():
    rng = random.Random(3)
    docs = [(7 * k, "".join(rng.choice("abcd éß") for _ in range(rng.choice([0, 1, 30, 3000])))) for k in range(90)]
    return docs + [(None, "null id"), (1000, None), (1001, ""), (1002, "end")]


def test_report(spark, monkeypatch):
    monkeypatch.setattr(E, "PART", 10)
    docs = _docs()
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, part string").repartition(5)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    texts = [t or "" for _, t in order]
    changed = [E.edited(t, u) for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    e = E.Embedder()
    own, new = e.fingerprints(texts), e.fingerprints(changed)
    rows = {r["doc_id"]: r for r in E.edit_report(df).collect()}
    assert len(rows) == len(docs)
    for k, (d, _) in enumerate(order):
        r = rows[d]
        assert r["n_chars"] == len(texts[k]) and r["edited_sha256"] == hashlib.sha256(changed[k].encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[k], new[k])
        assert r["near_edited"] == E.likeness(own[k], new[k]) and r["near_next"] == E.likeness(own[k], own[(k + 1) % len(own)])


def test_one_row_repeated_rows_and_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert E.edit_report(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert E.edit_report(one.unionAll(one)).count() == 2
    assert E.edit_report(one.limit(0)).count() == 0


def test_near_documents(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(20)]
    docs = list(enumerate(texts)) + [(100 + k, t[:300] + "#" + t[301:]) for k, t in enumerate(texts)] + [(200, texts[0])]
    got = {(r["doc_id"], r["near_id"], r["distance"]) for r in E.near_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= {(100 + k, k, 1) for k in range(20)} and len(got) >= 19
    assert np.all([d == 1 for *_, d in got])


def test_near_documents_does_not_lose_pairs_with_the_size(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choices("etaoin shrdlu", k=n))
    docs = [(k, say(rng.randrange(1024, 2040))) for k in range(2500)]
    planted = set()
    for k in range(150):
        t, of = list(docs[16 * k][1]), 16 * k
        for _ in range(10):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yz"])
        docs.append((10_000 + k, "".join(t)))
        planted.add((10_000 + k, of))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {}
    for block in (2048, 600):  # groups whole, and cut into blocks that meet
        monkeypatch.setattr(E, "BLOCK", block)
        got[block] = {(r["doc_id"], r["near_id"]) for r in E.near_documents(df).collect()}
    assert got[600] == got[2048] <= planted
    assert len(got[2048]) >= 0.96 * len(planted)


def test_text_classes(spark):
    docs = [(5, "a"), (3, "a"), (4, "b"), (9, None), (8, ""), (None, "a")]
    got = {tuple(r) for r in E.text_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (4, 4), (9, 8), (8, 8)}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=60), st.integers(0, 59), st.text("abc", max_size=4))
def test_far_hides_no_near_pair(a, at, put):
    b = a[:at] + put + a[at + len(put) // 2 :]
    assert not E.far(a, b, _levenshtein(a, b))


def test_recall_of_pairs_near_the_limit(spark):
    rng = random.Random(12)
    say = lambda n: "".join(rng.choices("etaoin shrdlu", k=n))
    docs = [(k, say(rng.choice([300, 700, 1500, 5000]))) for k in range(160)]
    planted = set()
    for k in range(80):
        t = list(docs[2 * k][1])
        for _ in range(len(t) * 3 // 100):  # about four characters in a hundred
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yz"])
        docs.append((1000 + k, "".join(t)))
        if E.edit_distance(docs[2 * k][1], docs[-1][1], len(t) // 20) is not None:
            planted.add((1000 + k, 2 * k))
    got = {(r["doc_id"], r["near_id"]) for r in E.near_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert len(planted) > 60 and len(got & planted) >= 0.9 * len(planted)
