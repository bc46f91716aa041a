"""SimHash near-duplicates by BK-trees (operator 9).

Fingerprints that differ in at most ``RADIUS`` of 64 bits agree on at least one
of ``RADIUS + 1`` blocks of bits, so each distinct fingerprint goes to one
shard for each block and a shard holds those that agree there. A shard of more
than ``SHARD`` fingerprints is dealt out again by blocks of its other bits, and
again while it is too large: every round leaves a quarter of the bits less to
differ in, so a few rounds make any shard small, however dense the
fingerprints lie, and rows grow by a constant at most.
Each shard's fingerprints go into a BK-tree, whose children are keyed by their
Hamming distance to the parent; a search follows only edges within the radius.
A shard gives one edge per fingerprint to the root of its group there, never
all pairs, and alternating star contraction joins the groups over shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import forget, released, small_batches, written

RADIUS = 3
#: Words in a shingle.
SHINGLE = 3
SEED = 42
#: Keys of documents that go, to be broadcast at most (16 bytes each, with the text's hash); above that the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: Most fingerprints in one BK-tree.
SHARD = 2048

# A-Z lower-cased, all other bytes kept.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of each shingle of the text, repeats included."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [h(b" ".join(words), SEED)]
    return [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash: a bit is set if it is set in over half the hashes; no words give zero."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    up = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(up, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, text_hash: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, if wanted, text_hash of every row; whole texts, no shuffle."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            more = [b.column(2)] if text_hash else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *more], names=["doc_id", "fp", "text_hash"][: 2 + len(more)])

    rows = documents.select("doc_id", "text", *[F.xxhash64("text").alias("text_hash")] * text_hash)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, fp bigint" + ", text_hash bigint" * text_hash)


class BKTree:
    """Fingerprints in a tree whose children are keyed by their distance to the parent."""

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Places of the values within the radius."""
        out: list[int] = []
        if not self.values:
            return out
        r, values, children, stack = self.radius, self.values, self.children, [0]
        while stack:
            k = stack.pop()
            d = (values[k] ^ value).bit_count()
            if d <= r:
                out.append(k)
            if below := children[k]:
                if len(below) <= 2 * r:
                    stack += [c for e, c in below.items() if d - r <= e <= d + r]
                else:
                    stack += [below[e] for e in range(max(1, d - r), d + r + 1) if e in below]
        return out

    def add(self, value: int) -> int:
        """Put in a value that isn't there; its place."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        k = 0
        while new:
            d = (self.values[k] ^ value).bit_count()
            nxt = self.children[k].get(d)
            if nxt is None:
                self.children[k][d] = new
                break
            k = nxt
        return new


def group_edges(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, root) for each value whose group in the shard has a smaller root."""
    tree, parent = BKTree(radius), []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for v in sorted(values):
        near = tree.near(v)
        k = tree.add(v)
        parent.append(k)
        for x in near:
            a, b = find(x), find(k)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(v, tree.values[r]) for k, v in enumerate(tree.values) if (r := find(k)) != k]


def _blocks(bits: list[int], n: int) -> list[tuple[int, ...]]:
    """The bits in n blocks of about equal size."""
    size, more = divmod(len(bits), n)
    out, at = [], 0
    for k in range(n):
        out.append(tuple(bits[at : at + size + (k < more)]))
        at += size + (k < more)
    return out


def _edges_of_shards(rows: DataFrame, radius: int) -> DataFrame:
    """Edges of the shards (fp, used, key); streams shard after shard, each of bounded size."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in found], dtype=np.uint64).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        now, values, found = None, [], []
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64).tolist()
            for key, v in zip(zip(*(b.column(i).to_pylist() for i in (1, 2)), strict=True), fp, strict=True):
                if key != now:
                    if len(values) > 1:
                        found += group_edges(values, radius)
                    now, values = key, []
                values.append(v)
            if len(found) >= 10_000:
                yield batch(found)
                found = []
        if len(values) > 1:
            found += group_edges(values, radius)
        yield batch(found)

    keys = ["used", "key"]
    return rows.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), "a bigint, b bigint")


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, used, key): each row (fp, used) dealt to the blocks of the bits that its shard has not used yet.

    ``used`` is a mask of the bits on which the shard agrees, key what they are.
    """

    def run(batches):
        for b in batches:
            fp, used = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            out = [[], [], []]
            for mask in np.unique(used).tolist():
                mine = fp[used == mask]
                for block in _blocks([k for k in range(64) if not mask >> k & 1], radius + 1):
                    now = np.uint64(mask | sum(1 << k for k in block))
                    for col, x in zip(out, (mine, np.full(len(mine), now), mine & now), strict=True):
                        col.append(x.view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in out], names=["fp", "used", "key"])

    return rows.select("fp", "used").mapInArrow(released(run), "fp bigint, used bigint, key bigint")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) whose components are those of all links.

    ``fps`` holds distinct fingerprints, fp.
    """
    spark, parts = fps.sparkSession, []
    rows, left = fps.select("fp", F.lit(0).cast("long").alias("used")), 64 - F.bit_count("used")
    while True:
        dealt = _dealt(rows, radius)
        # at most (all rows) / shard keys are large; Spark chooses the join by their size
        large = written(spark, dealt.groupBy("used", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard), "simhash-large")
        if large.isEmpty():
            parts.append(_edges_of_shards(dealt, radius))
            break
        parts.append(_edges_of_shards(dealt.join(large, ["used", "key"], "left_anti"), radius))
        again = written(spark, dealt.join(large, ["used", "key"], "left_semi").select("fp", "used", "key").distinct(), "simhash-again")
        # with no more bits left than the radius all link with the least
        alike = again.where(left <= radius)
        least = alike.groupBy("used", "key").agg(F.min("fp").alias("b"))
        parts.append(alike.join(least, ["used", "key"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))
        rows = again.where(left > radius)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the smallest node (signed) of its component.

    Alternating large and small star contraction; each round is written to the
    shared folder, and the rounds grow with the logarithm of the size.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(spark, pairs, name)
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")).where("a <> b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        last, pairs = pairs, written(spark, small, name)
        forget(last)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id whose fingerprint is reachable over
    links of at most ``radius`` bits, itself included. Null, empty and
    wordless texts have fingerprint zero and link like any other. A null
    doc_id keeps its row and never names a component unless all its members'
    are null; repeated rows each keep theirs. Other columns are left out.
    """
    spark = documents.sparkSession
    docs = written(spark, fingerprints(documents), "simhash-docs")
    fps = written(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    rooted = _rooted(fps, radius)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(spark, rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(fps: DataFrame, radius: int) -> DataFrame:
    """fp, first_id and the component's root of distinct fingerprints."""
    roots = components(links(fps.select("fp"), radius), "simhash-stars")
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def one_of_each(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns: one of each component.

    A row is known by doc_id and a hash of its text. The row of the smallest
    doc_id stays, null ids last, of one id that of the smallest hash, and of
    rows alike in both one; ids that repeat in other components don't matter.
    """
    spark = documents.sparkSession
    docs = written(spark, fingerprints(documents, text_hash=True), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    fps = written(spark, docs.groupBy("fp").agg(first.alias("first_id")), "simhash-distinct")
    kept = _rooted(fps, radius).groupBy("root").agg(F.min("first_id").alias("first"))
    kept = written(spark, kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")), "simhash-kept")
    counts = docs.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    gone = counts.join(kept, is_kept, "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = written(spark, gone, "simhash-gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = documents.join(few, documents["doc_id"].eqNullSafe(few["gone_id"]) & (F.xxhash64(documents["text"]) == few["gone_hash"]), "left_anti")
    if counts.where("n > 1").join(kept, is_kept, "left_semi").isEmpty():
        return rows
    same = max(documents.columns, key=len) + "_hash"  # none of the table's own
    return rows.withColumn(same, F.xxhash64("text")).dropDuplicates(["doc_id", same]).drop(same)


def brute_near_duplicates(docs: list[tuple], radius: int = RADIUS) -> list[dict]:
    """The same by comparing all pairs; for tests."""
    fps = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if group[i] != group[j] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
                    changed = True
    least = {g: min((d for (d, _), x in zip(docs, group, strict=True) if x == g and d is not None), default=None) for g in set(group)}
    return [{"doc_id": d, "fingerprint": f"{fp:016x}", "component_id": least[g]} for (d, _), fp, g in zip(docs, fps, group, strict=True)]
