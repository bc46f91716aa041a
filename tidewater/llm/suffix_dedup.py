"""Removal of repeated 100-byte strings by Burrows-Wheeler transforms (operator 10).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.
Windows are first dealt by their anchors (see ``anchors``): equal windows have
equal anchors, so only windows of one anchor string need to meet.

1. One pass cuts each text into runs of windows with one anchor. A run whose
   segment of bytes equals an earlier one (by 128 bits) repeats as a whole;
   each task combines its own before the shuffle, so a passage that stands in
   a third of all documents gives a row for each task, not for each document.
   Runs are sorted by anchor and content and stream through, one row held.
   Anchors that a sample shows to be common are dealt in parts by content.
2. Segments whose anchor string stands in different segments may repeat in
   part. Their bytes are fetched and dealt by anchor string to shards of bounded
   size. For each shard, the Burrows-Wheeler transform of its segments is built,
   and breadth-first backward extension of intervals derives the longest common
   prefixes by increasing value, up to ``LENGTH``: places whose prefix isn't
   resolved by then agree on ``LENGTH`` bytes with their neighbour, and all but
   the first of each such class repeat.
3. An anchor string with more than ``GROUP`` different segments (where a common
   passage meets other text) would make a shard too large. Its segments are
   halved: the windows with the anchor in their front, and the others. All
   windows of a half have more bytes in common than the anchor, and these are
   the half's new key; halves that are equal as a whole are combined as in 1,
   the rest goes to shards as in 2, and what is still too large is halved again.
   After seven rounds a piece is one window and its key the whole of it.

Repeats are rows (document, start, number of windows); bytes beyond what stage
2 needs are never shuffled but for two joins of the texts by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.anchors import CHUNK, GRAM, LENGTH, Cutter
from tidewater.llm.common import forget, kept, released, small_batches, written

#: Segments of one key in a shard, at most.
GROUP = 2048
#: Bytes of a shard after which it is closed.
SHARD_BYTES = 1_000_000
#: One text in this many is read for common anchors. An anchor is common if it has at least HOT_RUNS
#: runs there and one in HOT_SHARE of all, so there are at most HOT_SHARE; it is dealt in SPREAD parts.
SAMPLED, HOT_RUNS, HOT_SHARE, SPREAD = 64, 32, 20_000, 64
#: Rows that are taken together where they stream.
TOGETHER = 100_000

def _cutter() -> Cutter:
    """The cutter, which stays in the Python worker."""
    return kept(("anchors",), Cutter)


def cut_texts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start in it, n, place of the anchor in the first window, anchor hash, digest) of the runs of the texts, in chunks of bounded size."""
    parts: list[tuple[int, int, bytes]] = []  # (text, place in it, bytes); long texts overlap by LENGTH - 1
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), CHUNK):
            piece = t[at : at + CHUNK + LENGTH - 1]
            if size + len(piece) > CHUNK + LENGTH:
                yield _cut(parts)
                parts, size = [], 0
            parts.append((k, at, piece))
            size += len(piece)
    if parts:
        yield _cut(parts)


def _cut(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in parts), dtype=np.uint8)
    size = np.array([len(p) for _, _, p in parts], dtype=np.int64)
    last = np.cumsum(size)
    which, start, n, place, gram, digest = _cutter().placed_runs(data, last - size, last)
    text, at = (np.array([p[i] for p in parts], dtype=np.int64) for i in (0, 1))
    return text[which], start - (last - size)[which] + at[which], n, place, gram, digest


# --- suffix arrays, transforms and intervals ---
# Texts are symbols: 0 ends the whole and stands once, 1 ends a segment, byte b is b + 2.
_SYMBOLS = 258


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes, compared on at least ``depth`` symbols; by prefix doubling."""
    n, span = len(text), 7
    key = np.zeros(n, dtype=np.uint64)
    for k in range(span):
        key *= np.uint64(_SYMBOLS)
        key[: max(n - k, 0)] += text[k:].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
    rank[n] = -1
    while span < depth:
        ranks = rank[order]
        same = ranks[1:] == ranks[:-1]
        slots = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(slots):
            break
        # only places that still tie with another are sorted again
        places = order[slots]
        pair = rank[places] * (n + 2) + rank[np.minimum(places + span, n)] + 1
        by = np.argsort(pair, kind="stable")
        order[slots], pair = places[by], pair[by]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        # a place's rank is now the first slot of its class
        rank[order] = np.arange(n)
        rank[order[slots]] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        span *= 2
    return order


def agreeing(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each slot of the order, whether its suffix agrees with that of the slot before on ``depth`` symbols.

    Intervals of the transform grow breadth-first: from the interval of a
    string w follow those of cw, for each symbol c before it. Where the
    interval of a string of l + 1 symbols is the first to end, the common
    prefix there has l symbols, so they come by increasing value; only such
    intervals are extended (Beller, Gog, Ohlebusch and Schnattinger). Slots
    that are not reached before ``depth`` agree on at least that much.
    """
    n = len(text)
    before = text[order - 1].astype(np.int64)  # the transform
    count = np.bincount(before, minlength=_SYMBOLS)
    base = np.cumsum(count) - count  # the first slot of the suffixes that start with c
    by_symbol = np.argsort(before, kind="stable")
    nth = np.empty(n, dtype=np.int64)  # how many of its symbol come before it in the transform
    nth[by_symbol] = np.arange(n) - base[before[by_symbol]]
    key = before[by_symbol] * (n + 1) + by_symbol
    later = np.full(n, n, dtype=np.int64)  # the next slot of the same symbol
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    unresolved = np.ones(n + 1, dtype=bool)
    unresolved[0] = unresolved[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        size = high - low
        slot = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        owner = np.repeat(np.arange(len(low)), size)
        last = later[slot] >= high[owner]  # once for each symbol of an interval
        slot, owner = slot[last], owner[last]
        end = base[before[slot]] + nth[slot] + 1
        new = unresolved[end]
        slot, owner, end = slot[new], owner[new], end[new]
        unresolved[end] = False
        c = before[slot]
        low, high = np.searchsorted(key, c * (n + 1) + low[owner]), end
    return unresolved[:n]


def repeats(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows (all places that start ``length`` bytes) also start earlier,
    in a segment before or before in the same."""
    size = np.array([len(x) for x in segments], dtype=np.int64)
    text = np.frombuffer(b"\n".join(segments) + b"\n\n", dtype=np.uint8).astype(np.int16) + 2
    first = np.cumsum(size + 1) - size - 1
    text[first + size] = 1
    text[-1] = 0
    order = suffix_array(text, length)
    same = agreeing(text, order, length)
    # classes of successive slots; the first place of each class stays
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(order, head)
    again = np.zeros(len(text), dtype=bool)
    again[order] = same | np.concatenate((same[1:], [False]))
    again[least] = False
    return [again[a : a + max(n - length + 1, 0)] for a, n in zip(first, size, strict=True)]


# --- combining runs ---
# Rows are (kind, gram, part, digest, doc_id, text_hash, start, n, at) and perhaps bytes. Kind 0 is a run to
# combine, 1 a repeat, 2 a segment to compare; gram is the key that equal windows share, at the place of the
# anchor in the run's first window.

_HOLD = ["kind", "gram", "part", "digest", "doc_id", "text_hash", "start", "n", "at"]


def _schema(kind: str, carried: bool = False) -> str:
    return f"kind tinyint, gram bigint, part bigint, digest bigint, doc_id {kind}, text_hash bigint, start bigint, n int, at int" + ", bytes binary" * carried


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, n) of the runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    a = np.flatnonzero(edge == 1)
    return a, np.flatnonzero(edge == -1) - a


def _ranks(column: pa.Array) -> np.ndarray:
    """Order of the values as numbers, null lowest."""
    dense = pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    return dense.to_numpy().astype(np.int64)


def _local(doc: pa.Array, text_hash, which, start, n, at, gram, digest, spread: Callable, carried: list[bytes] | None = None) -> pa.RecordBatch:
    """Runs of one task's texts: the first of each class, and those that repeat it, marked; repeats that touch are one row.

    ``which`` says whose a run is, by place in ``doc`` and ``text_hash``;
    ``spread`` gives the part of a key in which a run is dealt.
    """
    rank, text_hash = _ranks(doc)[which], text_hash[which]
    by = np.lexsort((start, text_hash, rank, digest, gram))
    g, d, r, t, s = gram[by], digest[by], rank[by], text_hash[by], start[by]
    first = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    copy = ~first & np.concatenate(([False], (r[1:] == r[:-1]) & (t[1:] == t[:-1]) & (s[1:] == s[:-1])))
    heads, again = by[first], by[~first & ~copy]
    # in the order of the texts, so that runs that follow each other melt
    again = again[np.lexsort((start[again], text_hash[again], rank[again]))]
    joins = (rank[again][1:] == rank[again][:-1]) & (text_hash[again][1:] == text_hash[again][:-1]) & (start[again][1:] <= (start + n)[again][:-1])
    new = np.flatnonzero(np.concatenate(([True], ~joins)))[: len(again)]
    last = np.append(new[1:], len(again)) - 1
    size = (start + n)[again[last]] - start[again[new]] if len(again) else np.zeros(0, dtype=np.int64)
    rows = np.concatenate((heads, again[new]))
    kind = np.repeat(np.array([0, 1], dtype=np.int8), [len(heads), len(new)])
    # repeats are dealt by document, to spread them
    by_doc = (which[again[new]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    zero = np.zeros(len(new), dtype=np.int64)
    cols = [
        pa.array(kind),
        pa.array(np.concatenate((gram[heads], by_doc)).view(np.int64)),
        pa.array(np.concatenate((spread(gram[heads], digest[heads]), zero))),
        pa.array(np.concatenate((digest[heads].view(np.int64), zero))),
        doc.take(pa.array(which[rows])),
        pa.array(text_hash[rows]),
        pa.array(start[rows]),
        pa.array(np.concatenate((n[heads], size)).astype(np.int32)),
        pa.array(np.concatenate((at[heads], zero)).astype(np.int32)),
    ]
    if carried is None:
        return pa.RecordBatch.from_arrays(cols, names=_HOLD)
    left = [carried[k] for k in heads.tolist()] + [None] * len(new)
    return pa.RecordBatch.from_arrays([*cols, pa.array(left, pa.binary())], names=[*_HOLD, "bytes"])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, part, class and place: the repeats, and the first of each class where a key has several.

    Whatever the size of a key or a class, only the rows in hand and one more
    are held: the first of the last key, while no second class has come.
    """
    last: tuple | None = None  # gram, part, digest, doc_id, text_hash, start of the row before
    several, waiting = False, None

    def step(t: pa.Table) -> pa.Table:
        nonlocal last, several, waiting
        out = t.filter(pc.equal(t["kind"], 1))
        t = t.filter(pc.equal(t["kind"], 0)).combine_chunks()
        if not t.num_rows:
            return out
        col = lambda c: t[c].to_numpy()
        doc = t["doc_id"].combine_chunks()
        codes = doc.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        gram, part, digest, text_hash, start = (col(c) for c in ("gram", "part", "digest", "text_hash", "start"))
        now = lambda k: (gram[k], part[k], digest[k], doc[k].as_py(), text_hash[k], start[k])
        new = lambda cols, n: np.concatenate(([last is None or last[:n] != now(0)[:n]], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        new_key, new_class = new([gram, part], 2), new([gram, part, digest], 3)
        copy = ~new([gram, part, digest, codes, text_hash, start], 6)
        key = np.cumsum(new_key) - new_key[0]
        classes = np.bincount(key, new_class)
        goes_on = not new_key[0]
        if goes_on:
            classes[0] += 2 if several else 1
        # parts of a common key can't tell whether it has several classes
        many = (classes > 1) | (part[np.concatenate(([0], np.flatnonzero(new_key[1:]) + 1))] > 0)
        kind = np.where(new_class, np.where(many[key], 2, 0), 1)
        keep = np.flatnonzero(~copy & (kind > 0))
        more = t.take(pa.array(keep)).set_column(0, "kind", pa.array(kind[keep].astype(np.int8)))
        head = waiting
        if goes_on and head is not None and many[0]:
            more = pa.concat_tables([more, head])
        if key[-1] or not goes_on:
            at = int(np.flatnonzero(new_key)[-1])
            head = t.slice(at, 1).set_column(0, "kind", pa.array([2], pa.int8()))
        several = bool(many[-1])
        waiting = None if several else head
        last = now(-1)
        return pa.concat_tables([out, more])

    for t in together(batches):
        yield from step(t).to_batches()


def together(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _combined(rows: DataFrame) -> DataFrame:
    order = ["gram", "part", "digest", F.col("doc_id").asc_nulls_first(), "text_hash", "start"]
    return rows.repartition("gram", "part").sortWithinPartitions(*order).mapInArrow(released(_reduced), rows.schema)


def _common_anchors(texts: DataFrame) -> np.ndarray:
    """The anchors of most runs in a sample of the texts; which they are changes no result."""
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_size(batches):
            for _, _, _, _, gram, digest in cut_texts([(x or "").encode() for x in t["text"].to_pylist()]):
                different = np.unique(np.stack((gram, digest)), axis=1)[0] if len(gram) else gram
                names, n = np.unique(different, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0).select("text")
    counts = some.mapInArrow(released(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(spark, counts, "repeats-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(HOT_RUNS, -(-total // HOT_SHARE))).select("gram").collect()  # at most HOT_SHARE
    forget(counts)
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``CHUNK`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


# --- keys with many segments ---


def _halves(at: int, n: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first window, windows, place of the anchor in the first, start and end of the common bytes, half) of the
    halves of a run whose anchor lies between ``low`` and ``high`` in the windows of its key."""
    middle = (low + high) // 2
    for half, (a, b) in enumerate(((low, middle), (middle + 1, high))):
        top, bottom = min(at, b), max(at - n + 1, a)
        if top >= bottom and a <= b:
            # every window with the anchor at a to b covers these bytes
            yield at - top, top - bottom + 1, top, at - a, at - b + LENGTH, half


def _ranges(level: int) -> list[tuple[int, int]]:
    """The ranges of the anchor's place after so many halvings, in the order of their numbers."""
    out = [(0, LENGTH - GRAM)]
    for _ in range(level):
        out = [x for a, b in out for x in ((a, (a + b) // 2), ((a + b) // 2 + 1, b))]
    return out


def _halved(level: int) -> Callable:
    """Rows (gram, doc_id, text_hash, start, n, at, bytes) of that level as combined rows of the next."""
    ranges = _ranges(level)

    def number(at: int) -> int:
        return next(k for k, (a, b) in enumerate(ranges) if a <= at <= b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in together(batches):
            which, out, raw = [], [], []
            for k, (gram, start, n, at, data) in enumerate(zip(*(t[c].to_pylist() for c in ("gram", "start", "n", "at", "bytes")), strict=True)):
                for first, some, place, a, b, half in _halves(at, n, *ranges[number(at)]):
                    piece = data[first : first + some + LENGTH - 1]
                    key = hashlib.blake2b(b"%d %d " % (gram, half) + data[a:b], digest_size=8).digest()
                    digest = hashlib.blake2b(b"%d %d " % (place, some) + piece, digest_size=8).digest()
                    which.append(k)
                    out.append((start + first, some, place, int.from_bytes(key, "little"), int.from_bytes(digest, "little")))
                    raw.append(piece)
            if which:
                start, n, at = (np.array([x[i] for x in out], dtype=np.int64) for i in range(3))
                gram, digest = (np.array([x[i] for x in out], dtype=np.uint64) for i in (3, 4))
                doc, hashes = t["doc_id"].combine_chunks(), t["text_hash"].to_numpy()
                spread = lambda g, d: (d % np.uint64(SPREAD)).astype(np.int64) + 1
                yield _local(doc, hashes, np.array(which), start, n, at, gram, digest, spread, raw)

    return run


# --- the operator ---


def _with_texts(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` joined with ``lists``, a written table of one row for each of some documents."""
    same = F.col("t.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("t.text_hash") == F.col("l.text_hash"))
    cols = ["t.*", *[F.col(f"l.{c}") for c in lists.columns if c not in ("doc_id", "text_hash")]]
    return texts.alias("t").join(lists.hint("merge").alias("l"), same, how).select(*cols)


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, starts and sizes: for each document that has any, the windows that repeat,
    as runs of starting places in its UTF-8 bytes (a run of n windows covers n + 99 bytes).

    Documents go by doc_id, null first; where ids repeat, rows of one id go by
    a hash of their text, and rows alike in both are one document. Texts under
    100 bytes have no windows; null texts are empty; an empty table gives no
    rows; other columns are left out.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = _texts(documents)
    hot = _common_anchors(texts)

    def spread(gram: np.ndarray, digest: np.ndarray) -> np.ndarray:
        return np.where(np.isin(gram, hot), (digest % np.uint64(SPREAD)).astype(np.int64) + 1, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_size(batches):
            data = [(x or "").encode() for x in t["text"].to_pylist()]
            doc, hashes = t["doc_id"].combine_chunks(), t["text_hash"].to_numpy()
            for which, start, n, at, gram, digest in cut_texts(data):
                yield _local(doc, hashes, which, start, n, at, gram, digest, spread)

    found = written(spark, _combined(texts.mapInArrow(released(cut), _schema(kind))), "repeats-runs")

    # segments that may repeat in part: their bytes, by document and then by gram
    parts = found.where("kind = 2").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("gram", "start", "n", "at")).alias("parts"))
    parts = written(spark, parts, "repeats-parts")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, (text, some) in enumerate(zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True)):
                data = text.encode()
                out += [(p["gram"], k, p["start"], p["n"], p["at"], data[p["start"] : p["start"] + p["n"] + LENGTH - 1]) for p in some]
            rows = pa.array([x[1] for x in out], pa.int64())
            cols = [pa.array([x[i] for x in out], kind) for i, kind in ((0, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()), (5, pa.binary()))]
            yield pa.RecordBatch.from_arrays([cols[0], b.column("doc_id").take(rows), b.column("text_hash").take(rows), *cols[1:]], names=_PIECE)

    pieces = _with_texts(texts, parts, "inner").mapInArrow(released(fetch), f"gram bigint, doc_id {kind}, text_hash bigint, start bigint, n int, at int, bytes binary")
    pieces = written(spark, pieces, "repeats-segments")

    plain = ["doc_id", "text_hash", "start", "n"]
    every, level = [found.where("kind = 1").select(*plain)], 0
    while True:
        sizes = pieces.groupBy("gram").agg(F.count("*").alias("size"))
        large = written(spark, sizes.where(F.col("size") > GROUP).select("gram"), "repeats-large")
        done = large.isEmpty()
        small = pieces if done else pieces.join(large, "gram", "left_anti")
        if level:  # a key's only piece meets nothing
            small = small.join(sizes.where("size > 1").select("gram"), "gram", "left_semi")
        every.append(small.select("gram", *plain[:3], "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(released(_shards), f"doc_id {kind}, text_hash bigint, start bigint, n int"))
        if done:
            break
        halves = pieces.join(large, "gram", "left_semi").select(*_PIECE).mapInArrow(released(_halved(level)), _schema(kind, True))
        halves = written(spark, _combined(halves), "repeats-halves")
        every.append(halves.where("kind = 1").select(*plain))
        pieces, level = halves.where("kind = 2").select(*_PIECE), level + 1
    out = every[0]
    for more in every[1:]:
        out = out.unionAll(more.select(*plain))
    # a document's own runs, at most one for each of its windows
    out = out.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    return out.select("doc_id", "text_hash", F.col("runs.start").alias("starts"), F.col("runs.n").alias("sizes"))


_PIECE = ["gram", "doc_id", "text_hash", "start", "n", "at", "bytes"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among segments (gram, doc_id, text_hash, start, bytes) sorted by gram, by shards of whole keys."""
    held, size, now = [], 0, None

    def flush(rows):
        rows.sort(key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]))
        doc, hashes, start, n = [], [], [], []
        for (d, h, at, _), again in zip(rows, repeats([x[3] for x in rows]), strict=True):
            for a, m in zip(*_spans(again), strict=True):
                doc.append(d)
                hashes.append(h)
                start.append(at + int(a))
                n.append(int(m))
        return pa.RecordBatch.from_arrays([pa.array(doc, doc_type), pa.array(hashes, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], names=["doc_id", "text_hash", "start", "n"])

    doc_type = None
    for b in batches:
        doc_type = b.column(1).type
        for gram, *row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if gram != now and size >= SHARD_BYTES:
                yield flush(held)
                held, size = [], 0
            now = gram
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, text and text_hash; the hash is 0 for all where ids don't repeat, to shuffle less."""
    ids = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    own = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64("text")
    return documents.select("doc_id", "text", own.alias("text_hash"))


def cut_repeats(documents: DataFrame) -> DataFrame:
    """``repeat_report`` with the bytes that stay, kept, instead of their hash."""
    return _removed(documents, True)


def repeat_report(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts under 100 bytes keep all. The first of two
    equal strings is that of the smaller doc_id, null before all, and of rows
    of one id that of the smaller text hash; rows alike in both are one
    document and keep the same. An empty table gives no rows.
    """
    return _removed(documents, False)


def _removed(documents: DataFrame, keep: bool) -> DataFrame:
    spark = documents.sparkSession
    spans = written(spark, repeated_spans(documents), "repeats-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, out = [], [], [], []
            for text, starts, sizes in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "sizes")), strict=True):
                data, at, kept, n = (text or "").encode(), 0, [], 0
                end = -1
                for a, m in zip(starts or (), sizes or (), strict=True):
                    if a > end:
                        if end >= 0:
                            at = end
                        kept.append(data[at:a])
                        n += 1
                    end = max(end, a + m + LENGTH - 1)
                kept.append(data[max(end, 0) :])
                left = b"".join(kept)
                size.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(n)
                out.append(left if keep else hashlib.sha256(left).hexdigest())
            cols = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(out, pa.binary() if keep else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    last = "kept binary" if keep else "kept_sha256 string"
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _with_texts(_texts(documents), spans, "left").mapInArrow(released(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")


def brute_report(docs: list[tuple]) -> list[tuple]:
    """The report by a dictionary of all windows; for tests. Ids must differ."""
    seen: set[bytes] = set()
    out = []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - LENGTH + 1):
            w = data[k : k + LENGTH]
            if w in seen:
                gone[k : k + LENGTH] = True
            seen.add(w)
        left = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(left).hexdigest()))
    return out
