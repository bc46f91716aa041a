"""Benchmark decontamination by a generalised suffix automaton (operator 8).

The benchmark items are normalised to words and put into one suffix automaton
per shard of bounded size. Documents stream through it: the automaton's state
and the length of the longest match ending at each word tell which windows of
the items end there. Spans of such windows are then reported or removed.

A cheap test goes first: a match of two or more words needs every pair of
neighbouring words to be a pair of some item, so only stretches of such pairs
enter the automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import forget, kept, released, small_batches, written

#: Consecutive item words that make a window.
WINDOW = 13
#: Bytes of item text in one automaton; larger benchmarks take several passes.
SHARD_BYTES = 4_000_000

# A word is a run of these bytes (digits, a-z, anything beyond ASCII), A-Z lower-cased first.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """A generalised suffix automaton over the word sequences of benchmark items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._mark(coded)
        pairs = {(a, b) for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.base = len(self.vocab) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        #: The fewest words of a window; single-word windows are looked up by word alone.
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _at(self, state: int, size: int) -> int:
        """The state that holds the suffix of ``size`` words of what ``state`` holds."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        n = len(self.next)
        self.full: list[int] = [-1] * n  # the state of the last `window` words
        self.window_items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in coded:
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= self.window:
                    self.window_items.setdefault(self._at(state, self.window), set()).add(name)
            if len(ids) < self.window:
                self.short.setdefault(self._at(state, len(ids)), []).append((len(ids), name))
        order = sorted(range(n), key=self.length.__getitem__)
        self.above = [-1] * n  # the nearest state with short items, itself included
        for v in order:
            up = self.link[v]
            if v in self.short:
                self.above[v] = v
            elif up >= 0:
                self.above[v] = self.above[up]
            if self.length[v] >= self.window:
                self.full[v] = v if up < 0 or self.length[up] < self.window else self.full[up]

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that may hold a window."""
        if not len(ids) or not self.least:
            return []
        if self.least == 1:
            ok = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
            edge = np.diff(ok)
            return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        if not len(self.pairs):
            return []
        good = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if not len(good):
            return []
        key = ids[good] * self.base + ids[good + 1]
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        good = good[self.pairs[at] == key]
        if not len(good):
            return []
        cut = np.flatnonzero(np.diff(good) > 1)
        first = good[np.concatenate(([0], cut + 1))]
        last = good[np.concatenate((cut, [len(good) - 1]))] + 2
        long = last - first >= self.least
        return list(zip(first[long].tolist(), last[long].tolist(), strict=True))

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str | None]]:
        """Spans [start, end) of hit words, apart and ascending, and the items that occur."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        spans: list[list[int]] = []
        found: set[str | None] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for lo, hi in self.stretches(ids):
            state = size = 0
            for k, c in enumerate(ids[lo:hi].tolist(), lo):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    size += 1
                best = 0
                if size >= window:
                    best = window
                    found |= self.window_items[self.full[state]]
                up = self.above[state]
                while up >= 0:
                    for n, name in self.short[up]:
                        if n <= size:
                            best = max(best, n)
                            found.add(name)
                    up = self.above[link[up]] if link[up] >= 0 else -1
                if best:
                    add_span(spans, k + 1 - best, k + 1)
        return spans, found


def add_span(spans: list[list[int]], start: int, end: int) -> None:
    """Add a span whose end is the last so far; it may reach back over earlier ones."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


_SPANS = pa.list_(pa.int64())


def _automaton(key: str, shard: list, window: int) -> SuffixAutomaton:
    """A shard's automaton; the last one stays in the Python worker."""
    return kept(("decontamination", key, window), lambda: SuffixAutomaton([(name, words_of(text)) for name, text in shard], window))


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list]:
    """(item, text) of each shard: about ``shard_bytes`` of text at most, or one item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("body is not null")
    size = items.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
    n = -(-size // shard_bytes) * 2 if size > shard_bytes else 1
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(part == k)).collect()]


def matched(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, text: bool = True) -> DataFrame:
    """Match every whole document against every benchmark item.

    Returns, for each row: doc_id, text (unless ``text`` is false), n_words,
    spans (flat start, end word positions, apart and ascending) and items
    (ids of items with an occurring window, as strings, sorted). No shuffle.

    Null or empty texts have no words and no hits; items without words have no
    windows; an item with a null id hits words but isn't named; repeated rows
    are matched each on its own; other columns are left out.
    """
    small_batches(documents.sparkSession)
    out = documents.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    names = [c for c in out.columns if text or c != "text"]
    return _through(out, benchmark, window, shard_bytes, lambda b: b.select(names), out.select(*names).schema)


def _through(df: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, last: Callable, schema) -> DataFrame:
    """``df`` after one pass for each shard, which adds to its spans, items and n_words; ``last`` ends the last pass.

    One automaton is in a worker and one shard's items are broadcast at a
    time: after a pass that isn't the last, the rows are written and read again.
    """
    spark, before = df.sparkSession, None
    every = _shards(benchmark, shard_bytes)
    shard = next(every)
    while shard is not None:
        following = next(every, None)
        shared = spark.sparkContext.broadcast(shard)  # about ``shard_bytes``
        key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"
        if following is None:
            return df.mapInArrow(released(_pass(shared, key, window, last)), schema)
        df = written(spark, df.mapInArrow(released(_pass(shared, key, window, lambda b: b)), df.schema), "decontamination-pass")
        shared.destroy()
        if before is not None:
            forget(before)
        shard = following
        before = df


def _merged(old: list[int], hit: list[list[int]]) -> list[int]:
    """Flat spans of both, apart and ascending."""
    if old:
        both, hit = sorted([*map(list, zip(old[::2], old[1::2], strict=True)), *hit]), []
        for a, b in both:
            if hit and a <= hit[-1][1]:
                hit[-1][1] = max(hit[-1][1], b)
            else:
                hit.append([a, b])
    return [x for s in hit for x in s]


def _pass(shard, key: str, window: int, last: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, shard.value, window)
        for batch in batches:
            n, spans, items = [], [], []
            for text, old, named in zip(*(batch.column(c) for c in ("text", "spans", "items")), strict=True):
                words = words_of(text.as_py())
                hit, found = auto.match(words)
                n.append(len(words))
                spans.append(_merged(old.as_py(), hit))
                items.append(sorted({*named.as_py(), *(x for x in found if x is not None)}) if found else named.as_py())
            for name, values in (("n_words", pa.array(n, pa.int64())), ("spans", pa.array(spans, _SPANS)), ("items", pa.array(items, pa.list_(pa.string())))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, values)
            yield last(batch)

    return run


def n_hit(spans):
    """Words in the flat spans (native)."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def contaminated(hit, words):
    """Whether a document's coverage exceeds the limit: one word in twenty (native)."""
    return (hit > 0) & (20 * hit >= words)


def decontamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = matched(documents, benchmark, text=False).withColumn("n_hit", n_hit(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the words of the flat spans and what stands between them."""
    marks = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : marks[a][0]])
        at = marks[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns, less what leaked.

    A document in which one word in twenty or more is hit goes. In others the
    hit spans (each at least a whole window) are cut from the text; documents
    without hits stay as they are, and so do null and empty texts. ``n_chars``,
    where there is such a column, is counted again for a cut text.
    """
    spark = documents.sparkSession
    small_batches(spark)
    names = documents.columns
    rest = [F.col(f"`{c}`") for c in names if c != "text"]
    row = documents.select(
        "doc_id", "text", F.struct(*rest).alias("row"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    stays = _through(row, benchmark, WINDOW, SHARD_BYTES, _cut, row.select("text", "row", F.lit(True).alias("changed")).schema)
    fields = []
    for c in names:
        col = F.col("text") if c == "text" else F.col("row").getField(c)
        if c == "n_chars":
            col = F.when(F.col("changed"), F.char_length("text").cast(documents.schema[c].dataType)).otherwise(col)
        fields.append(col.alias(c))
    return stays.select(*fields)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """text, row and changed of the rows that aren't contaminated, hit words cut from their texts."""
    texts, stay, changed = [], [], []
    for k, (text, n, spans) in enumerate(zip(*(batch.column(c) for c in ("text", "n_words", "spans")), strict=True)):
        text, spans = text.as_py(), spans.as_py()
        hit = sum(spans[1::2]) - sum(spans[::2])
        if not (hit and 20 * hit >= n.as_py()):
            stay.append(k)
            texts.append(cut_words(text, spans) if spans else text)
            changed.append(bool(spans))
    row = batch.column("row").take(pa.array(stay, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), row, pa.array(changed, pa.bool_())], names=["text", "row", "changed"])


def sha256_names(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def brute_report(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[dict]:
    """The report by trying every window at every place; for tests."""
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = words_of(text)
        if w:
            size = min(len(w), window)
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(name)
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[x]
        names = sorted(str(x) for x in found if x is not None)
        out.append({"doc_id": doc_id, "n_words": len(w), "n_hit": len(hit), "n_items": len(names), "items_sha256": sha256_names(names), "contaminated": bool(hit) and 20 * len(hit) >= len(w)})
    return out
