import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import anchors as A
from tidewater.llm import suffix_dedup as S


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=6), st.integers(1, 24))
def test_repeats_of_segments(segments, length):
    seen = set()
    for data, again in zip(segments, S.repeats(segments, length), strict=True):
        want = []
        for k in range(len(data) - length + 1):
            want.append(data[k : k + length] in seen)
            seen.add(data[k : k + length])
        assert again.tolist() == want


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    part = bytes(rng.choice(b"abcdef") for _ in range(600))
    texts = [part[k : k + 300] for k in range(0, 300, 7)] + [b"a" * 500, b"ab" * 250]
    last = np.cumsum([len(t) for t in texts])
    first = last - [len(t) for t in texts]
    text, start, n, gram, digest = A.Cutter().runs(np.frombuffer(b"".join(texts), dtype=np.uint8), first, last)
    assert n.sum() == sum(len(t) - 99 for t in texts)
    of, segment = {}, {}
    for k, s, m, g, d in zip(text, start, n, gram, digest, strict=True):
        t, s = texts[k], int(s - first[k])
        for i in range(s, s + m):
            assert of.setdefault(t[i : i + 100], g) == g
        assert segment.setdefault((g, d), t[s : s + m + 99]) == t[s : s + m + 99]


def _docs():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["über", "alpha", "beta", "gamma", "delta", "日本", "x", "yy"]) + str(rng.randrange(200)) for _ in range(n))
    passage, docs = say(60), []
    for k in range(60):
        docs.append((3 * k, f"{say(rng.choice([2, 40, 120]))} {passage if k % 3 == 0 else say(20)} {say(30)}"))
    docs += [(1000 + k, docs[k][1]) for k in range(10)]
    for k in range(10):  # near copies, some with smaller ids
        t = docs[20 + k][1].split(" ")
        t[rng.randrange(len(t))] = "edit"
        docs.append((3 * k + 1, " ".join(t)))
    return docs + [(2000, "a" * 1000), (2001, "a" * 99), (2002, "a" * 100), (2003, None), (2004, ""), (None, passage), (2005, say(20) + passage + passage)]


def test_report_equals_brute_force(spark, monkeypatch):
    docs = _docs()
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, start string, n int").repartition(7)
    want = sorted(S.brute_report(docs), key=str)
    assert sum(x[2] for x in want) > 10_000
    assert sorted((tuple(r) for r in S.repeat_report(df).collect()), key=str) == want
    monkeypatch.setattr(S, "GROUP", 3)  # now most are halved again and again
    assert sorted((tuple(r) for r in S.repeat_report(df).collect()), key=str) == want
    monkeypatch.setattr(S, "SAMPLED", 1)
    monkeypatch.setattr(S, "HOT_RUNS", 4)  # and common anchors are dealt in parts
    monkeypatch.setattr(S, "TOGETHER", 50)
    assert sorted((tuple(r) for r in S.repeat_report(df).collect()), key=str) == want


def test_repeated_rows_and_empty(spark):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (1, text[50:] + "!"), (2, text)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in S.repeat_report(df).collect())
    whole = [r for r in rows if r[1] == 300]
    assert len(rows) == 4 and whole[-1] == (2, 300, 300)  # all of it starts earlier
    assert whole[0] == whole[1]  # rows alike are one document
    assert S.repeat_report(df.limit(0)).count() == 0


def _brute_spans(docs):
    """(doc_id, removed bytes) by digests of all windows."""
    seen, out = set(), {}
    for d, data in sorted(docs):
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 99):
            h = hash(data[k : k + 100])
            if h in seen:
                gone[k : k + 100] = True
            seen.add(h)
        out[d] = int(gone.sum())
    return out


def test_text_over_the_chunk(spark):
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz  "
    body = "".join(rng.choices(alphabet, k=A.CHUNK + 300_000))
    passage = body[A.CHUNK - 150 : A.CHUNK + 150]  # stands where the text is cut
    docs = [(1, body), (2, "x" * 70 + passage + "y" * 70), (3, body[5:400] + body[-400:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _brute_spans([(d, t.encode()) for d, t in docs])
    assert want[2] >= 300 and want[3] >= 795
    assert {r["doc_id"]: r["n_removed"] for r in S.repeat_report(df).collect()} == want


def test_passage_in_very_many_documents(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = say(170)
    docs = [(k, say(60) + passage + say(60)) for k in range(10_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    want = _brute_spans([(d, t.encode()) for d, t in docs])
    assert {r["doc_id"]: r["n_removed"] for r in S.repeat_report(df).collect()} == want
