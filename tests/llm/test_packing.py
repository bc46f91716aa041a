import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing as P


def _best_fit(lengths, sequence):
    """Plain best-fit decreasing, a piece at a time: how many sequences."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(sequence - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit(counts):
    slots = defaultdict(list)
    ranks = defaultdict(set)
    for size, rank, n, seq, offset in P.plan(counts, 40):
        for k in range(n):
            slots[seq + k].append((offset, size))
            ranks[size].add(rank + k)
    assert {s: len(r) for s, r in ranks.items()} == counts
    assert all(r == set(range(len(r))) for r in ranks.values())
    for s in slots.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= 40
    assert len(slots) == _best_fit(list(Counter(counts).elements()), 40)


def test_pack_round_trip(spark):
    rng = random.Random(2)
    words = ["The", "über", "ça", "12", "can't", "\n\n", "x" * 70, "日本語", "<|endoftext|>", "  ", "?!"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "\t \n "), (3, docs[3][1]), (None, "null id")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, length string")
    t = Tokenizer.from_file(P.default_vocabulary())
    want = Counter()
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    rows = P.pack(df).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) == _best_fit([r["length"] for r in rows], 2048)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
