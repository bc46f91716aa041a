"""Document fingerprints by a randomised edit embedding (operator 2).

A walk reads a text from the left: at step t it writes the character under it
and then moves on by one or stays, as a random bit of (t, character) that all
texts share says. Two walks that drift apart at an edit meet again soon, so a
small edit distance becomes a small Hamming distance of what they wrote
(Chakraborty, Goldenberg and Koucky). A fingerprint samples bits of the written
string at fixed random steps. As texts differ in length by orders of magnitude,
the steps are drawn for scales, each twice the one before; a text is sampled at
its own scale and the next, and texts whose lengths are within a factor of two
share one.

Near pairs come from bands of sampled bits and are verified on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import kept, released, small_batches, written

SEED = 42
#: Bits sampled at each scale.
BITS = 256
#: Classes of characters that the walk tells apart; class 0 is the end.
CLASSES = 256
#: Steps after which the shared random bits come round again.
PERIOD = 1 << 14
#: Bits in a band, and bands, of the candidate search.
BAND_BITS, BANDS = 16, 24
#: Most rows of a band group that one task compares; larger groups are cut into blocks that meet two by two.
BLOCK = 2048
#: Scale from which pairs of a band go by their samples before their texts are compared, and the
#: standard deviations by which these must agree more often than those of unrelated texts.
FILTERED, CHANCE = 9, 1.0
#: Characters in the n-grams that show texts to be far apart.
GRAM = 6
#: Code points of texts that are walked together, about.
_TOGETHER = 2_000_000


def _moves() -> np.ndarray:
    """The shared random bits: moves[t, class] is 0 or 1; the end stays."""
    moves = np.random.default_rng(SEED).integers(0, 2, (PERIOD, CLASSES), dtype=np.int64)
    moves[:, 0] = 0
    return moves


def _classes(text: str) -> np.ndarray:
    """The class, from 1 up, of each character, by a multiplicative hash of its code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(CLASSES - 1) + np.uint64(1)


def scale_of(n_chars: int) -> int:
    return max(4, int(n_chars).bit_length())


def sample_steps(scale: int) -> np.ndarray:
    """The ascending steps sampled at a scale: within the walk of a text of 2**scale characters."""
    rng = np.random.default_rng([SEED, scale])
    return np.sort(rng.integers(0, 2 << scale, BITS))


def sample_bits(scale: int) -> np.ndarray:
    """bits[k, class]: the bit that the k-th sample of a scale takes from what is written there."""
    return np.random.default_rng([SEED, scale, 1]).integers(0, 2, (BITS, CLASSES), dtype=np.uint8)


class Embedder:
    """Walks many texts at once."""

    def __init__(self):
        self.moves = _moves()
        self._steps: dict[int, np.ndarray] = {}
        self._bits: dict[int, np.ndarray] = {}

    def samples(self, scale: int) -> tuple[np.ndarray, np.ndarray]:
        if scale not in self._steps:
            self._steps[scale], self._bits[scale] = sample_steps(scale), sample_bits(scale)
        return self._steps[scale], self._bits[scale]

    def written(self, texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(scale, classes written at its samples, and at those of the next scale) of each text."""
        out: list = [None] * len(texts)
        by_scale: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            by_scale.setdefault(scale_of(len(t)), []).append(k)
        for scale, rows in by_scale.items():
            size = max(1, _TOGETHER >> scale)
            for a in range(0, len(rows), size):
                part = rows[a : a + size]
                for k, x, y in zip(part, *self._walk([texts[k] for k in part], scale), strict=True):
                    out[k] = (scale, x, y)
        return out

    def _walk(self, texts: list[str], scale: int) -> tuple[np.ndarray, np.ndarray]:
        own, wide = self.samples(scale)[0], self.samples(scale + 1)[0]
        n = len(texts)
        flat = np.zeros(sum(map(len, texts)) + n, dtype=np.int64)
        at, pos = np.empty(n, dtype=np.int64), 0
        for k, t in enumerate(texts):
            at[k] = pos
            flat[pos : pos + len(t)] = _classes(t)
            pos += len(t) + 1
        out = [np.zeros((n, BITS), dtype=np.uint8), np.zeros((n, BITS), dtype=np.uint8)]
        takes: dict[int, list[tuple[int, int]]] = {}
        for which, steps in enumerate((own, wide)):
            for k, t in enumerate(steps.tolist()):
                takes.setdefault(t, []).append((which, k))
        live, moves = np.arange(n), self.moves
        for t in range(max(takes) + 1):
            c = flat.take(at)
            for which, k in takes.get(t, ()):
                out[which][live, k] = c
            at += moves[t % PERIOD].take(c)
            if t % 512 == 511:  # texts that ended write only zeros from here
                going = flat.take(at) > 0
                if not going.all():
                    at, live = at[going], live[going]
                    if not len(live):
                        break
        return out[0], out[1]

    def fingerprints(self, texts: list[str]) -> list[str]:
        """The fingerprint of each text: its scale, then for it and the next scale which samples
        lie within the text (they are the first ones) and the sampled bits, in hexadecimal."""
        out = []
        for scale, *both in self.written(texts):
            parts = [f"{scale:02x}"]
            for s, wrote in zip((scale, scale + 1), both, strict=True):
                inside = int((wrote > 0).sum())
                bits = self.samples(s)[1][np.arange(BITS), wrote] * (wrote > 0)
                parts.append(f"{inside:03x}{np.packbits(bits).tobytes().hex()}")
            out.append("-".join(parts))
        return out


def _read(fingerprint: str) -> dict[int, tuple[int, np.ndarray]]:
    scale, *parts = fingerprint.split("-")
    return {int(scale, 16) + k: (int(p[:3], 16), np.unpackbits(np.frombuffer(bytes.fromhex(p[3:]), dtype=np.uint8))) for k, p in enumerate(parts)}


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1: at the widest scale that both have, the share of
    samples within either text that agree, less what agrees by chance."""
    if a == b:
        return 1.0
    x, y = _read(a), _read(b)
    shared = x.keys() & y.keys()
    if not shared:
        return 0.0
    # the scale of which the longer text fills the most
    scale = min(shared)
    (m, p), (n, q) = x[scale], y[scale]
    if not max(m, n):
        return 1.0
    same = int((p[: min(m, n)] == q[: min(m, n)]).sum())
    return max(0.0, min(1.0, 2 * (same + abs(m - n) / 2) / max(m, n) - 1))


def bands(fingerprint: str) -> list[str]:
    """Keys of the candidate search: bits at fixed random places, for both scales of the fingerprint.

    Bits past a text's end are zero, so texts of about the same length agree there too.
    """
    pick = np.random.default_rng([SEED, 2]).permuted(np.tile(np.arange(BITS), (BANDS, 1)), axis=1)[:, :BAND_BITS]
    return [f"{scale:x}.{k}.{np.packbits(row).tobytes().hex()}" for scale, (_, bits) in _read(fingerprint).items() for k, row in enumerate(bits[pick])]


def _embedder() -> Embedder:
    """The walker, which stays in the Python worker."""
    return kept(("edit embedding",), Embedder)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text; null is empty; no shuffle."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_embedder().fingerprints([t or "" for t in b.column(1).to_pylist()]))], names=["doc_id", "fingerprint"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


#: Documents in one part of the order by doc_id, at least, and parts, at most.
PART, PARTS = 4000, 10_000
#: Code points that are held before their fingerprints are taken.
HELD_CHARS = 16_000_000


def _with_next(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Rows (part, copy, doc_id, text) in parts of the order by doc_id, nulls first, then by text hash.

    Parts are cut at quantiles of doc_id. The first row of each part comes a
    second time as a copy at the end of the part before (of the last part,
    for the first), so that each row's next stands in its own part.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.where("key is not null")
    total = docs.count()
    n = total // max(PART, total // PARTS)
    cuts = sorted({int(x) for x in ids.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    docs = docs.withColumn("part", _part_of(spark, cuts)(F.col("key")))
    order = ["key", F.xxhash64("text")]
    heads = docs.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("head")).orderBy("part").collect()
    heads = [(r["part"], r["head"]["key"]) for r in heads]  # one small row for each part
    before = [(p, k, heads[i - 1][0]) for i, (p, k) in enumerate(heads)]
    firsts = spark.createDataFrame(before, "part int, head long, to_part int")
    copies = docs.join(F.broadcast(firsts), ["part"]).where(F.col("key").eqNullSafe(F.col("head"))).select("key", "doc_id", "text", F.col("to_part").alias("part"), F.lit(1).alias("copy"))
    rows = docs.select("key", "doc_id", "text", "part", F.lit(0).alias("copy")).unionByName(copies)
    return rows.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "copy", *order).select("part", "copy", "doc_id", "text")


def _part_of(spark: SparkSession, cuts: list[int]):
    """The number of cuts at or below an id; null comes before all."""
    shared = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        low = np.iinfo(np.int64).min
        return pd.Series(np.searchsorted(shared.value, key.fillna(low).to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return part


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is that of the next doc_id, ascending, after the last
    the first; null ids come first, and rows of one id go by a hash of their
    text. A document alone is its own next. Null texts are empty. The texts
    are shuffled once, in parts of bounded size.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = _with_next(spark, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kind = None

        def flush(held):
            """All but the last row of what is held, each with its next."""
            embed = _embedder().fingerprints
            texts = [t for _, t in held]
            changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
            both = embed(texts + changed)
            own, prints = both[: len(texts)], both[len(texts) :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in held[:-1]], kind),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(own[:-1]),
                    pa.array(prints),
                    pa.array([likeness(a, b) for a, b in zip(own, prints, strict=False)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                ],
                names=names,
            )

        held, now, closed, size = [], None, False, 0
        for b in batches:
            kind = b.column(2).type
            for part, copy, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now:
                    held, now, closed, size = [], part, False, 0
                if closed:
                    continue  # more copies than one stand for rows of the same id
                held.append((doc_id, text))
                closed, size = bool(copy), size + len(text)
                if closed or size > HELD_CHARS:
                    yield flush(held)
                    held, size = held[-1:], 0

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``, else null; along diagonals, in O(most) memory."""
    if abs(len(a) - len(b)) > most:
        return None
    reach = {0: _along(a, b, 0, 0)}
    end = len(a) - len(b)
    for d in range(most + 1):
        if reach.get(end, -1) >= len(a):
            return d
        new = {}
        for k in range(-d - 1, d + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            if i >= 0 and i <= len(a) and 0 <= i - k <= len(b):
                new[k] = _along(a, b, i, i - k)
            elif i > len(a) and 0 <= len(a) - k <= len(b):
                new[k] = len(a)
        reach = new
    return None


def _along(a: str, b: str, i: int, j: int) -> int:
    """How far i goes while the texts agree; in blocks, as slices compare fast."""
    step = 64
    while step:
        while i + step <= len(a) and j + step <= len(b) and a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
        step //= 2
    return i


def _gram_counts(text: str, bits: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = np.zeros(max(0, len(points) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + points[k : k + len(h)]
    return np.bincount(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def far(a: str, b: str, most: int) -> bool:
    """Whether counts of n-grams show that the edit distance is over ``most``: an edit changes 2n of them at most."""
    if abs(len(a) - len(b)) > most:
        return True
    if min(len(a), len(b)) < GRAM or 2 * GRAM * most >= len(a) + len(b):
        return False
    bits = max(len(a), len(b)).bit_length() + 1
    return int(np.abs(_gram_counts(a, bits) - _gram_counts(b, bits)).sum()) > 2 * GRAM * most


def text_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row with an id: the smallest doc_id of an equal text. Null is empty.

    ``near_documents`` names classes by class_id; this says who is in them.
    """
    rows = documents.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    return rows.join(rows.groupBy("text_key").agg(F.min("doc_id").alias("class_id")), "text_key").select("doc_id", "class_id")


def _masks() -> np.ndarray:
    """masks[n]: the first n sampled bits, as four longs."""
    return np.packbits(np.arange(BITS) < np.arange(BITS + 1)[:, None], axis=1).view(np.uint64)


def _close(scale: int, chars: np.ndarray, inside: np.ndarray, bits: np.ndarray, mine: np.ndarray, own: bool, share: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) of rows, by ascending length, whose lengths allow the share of edits and whose
    samples agree more than chance has it; with ``own`` those of one block, else of different ones."""
    masks = _masks()
    for i in range(len(chars) - 1):
        # the edit distance is the difference of the lengths at least
        end = int(np.searchsorted(chars - (share * chars).astype(np.int64), chars[i], side="right"))
        if end <= i + 1:
            continue
        j = np.arange(i + 1, end)
        j = j[(mine[j] == mine[i]) == own]
        if scale >= FILTERED:
            n = np.minimum(inside[j], inside[i])
            apart = np.bitwise_count((bits[j] ^ bits[i]) & masks[n]).sum(axis=1)
            j = j[(apart <= n / 2 - CHANCE * np.sqrt(n) / 2) | (n < 16)]
        for k in j.tolist():
            yield i, k


def _candidates(banded: DataFrame, kind: str, share: float) -> DataFrame:
    """Distinct (doc_id, near_id), near_id smaller, of the rows of a band group that may be near.

    All rows of a group meet: a group of more than ``BLOCK`` is cut into
    blocks, and each two blocks meet in one task.
    """
    spark = banded.sparkSession
    large = written(spark, banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "edit-large")
    zero = F.lit(0).cast("long")
    small = banded.join(large, "band", "left_anti").withColumn("mine", zero).withColumn("part", zero).withColumn("own", F.lit(True))
    n = F.ceil(2 * F.col("n") / F.lit(BLOCK))
    cut = banded.join(large, "band").withColumn("n", n).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("n")))
    cut = cut.withColumn("other", F.explode(F.sequence(zero, F.col("n") - 1)))
    part = F.least("mine", "other") * F.col("n") + F.greatest("mine", "other")
    cut = cut.withColumn("part", part).withColumn("own", F.col("mine") == F.col("other"))
    # a block by itself is a part of its own; it is not compared again where it meets the others
    cut = cut.drop("n", "other")
    rows = small.unionByName(cut).repartition("band", "part").sortWithinPartitions("band", "part", "chars")

    def run(batches):
        held, now = [], None

        def found():
            doc_id, chars, inside, bits, mine, own = zip(*held, strict=True)
            packed = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(held), -1)
            pairs = _close(int(now[0].split(".")[0], 16), np.array(chars), np.array(inside), packed, np.array(mine), own[0], share)
            return [(max(doc_id[i], doc_id[j]), min(doc_id[i], doc_id[j])) for i, j in pairs if doc_id[i] != doc_id[j]]

        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], id_type) for k in (0, 1)], names=["doc_id", "near_id"])

        out, id_type = [], None
        for b in batches:
            id_type = b.column(2).type
            for band, part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, part) != now:
                    if len(held) > 1:
                        out += found()
                    held, now = [], (band, part)
                    if len(out) >= 10_000:
                        yield batch(out)
                        out = []
                held.append(row)
        if len(held) > 1:
            out += found()
        if out:
            yield batch(out)

    rows = rows.select("band", "part", "doc_id", "chars", "inside", "bits", "mine", "own")
    return rows.mapInArrow(released(run), f"doc_id {kind}, near_id {kind}").distinct()


def near_documents(documents: DataFrame, share: float = 0.05) -> DataFrame:
    """Pairs (doc_id, near_id, distance), near_id smaller: what shares a band and is near, verified.

    Equal texts are one class, named by its smallest id; ``text_classes`` has
    the members. All members of a band group are compared with each other: by
    length, which is exact, then by their samples, and texts whose samples
    agree more than chance has it by edit distance, which is at most ``share``
    of the longer text in the pairs that stay. The comparisons of samples grow
    with the square of a band group's size, in tasks of bounded size.
    """
    spark = documents.sparkSession
    small_batches(spark)
    classes = documents.where("doc_id is not null").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"))
    classes = written(spark, classes, "edit-classes")
    texts = classes.select("doc_id", "text")

    def explode(batches):
        for b in batches:
            wanted = b.column(1).to_pylist()
            prints = _embedder().fingerprints(wanted)
            rows, names, inside, bits = [], [], [], []
            for k, x in enumerate(prints):
                read = _read(x)
                for band in bands(x):
                    n, own = read[int(band.split(".")[0], 16)]
                    rows.append(k)
                    names.append(band)
                    inside.append(n)
                    bits.append(np.packbits(own).tobytes())
            at = pa.array(rows, pa.int64())
            chars = pa.array([len(t) for t in wanted], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(names, pa.string()), chars.take(at), pa.array(inside, pa.int32()), pa.array(bits, pa.binary())], names=["doc_id", "band", "chars", "inside", "bits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    banded = written(spark, texts.mapInArrow(released(explode), f"doc_id {kind}, band string, chars long, inside int, bits binary"), "edit-bands")
    pairs = written(spark, _candidates(banded, kind, share), "edit-pairs")
    both = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("near_id"), F.col("text").alias("near_text")), "near_id")

    def verify(batches):
        for b in batches:
            most = [(x, y, int(share * max(len(x), len(y)))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            d = [None if far(*m) else edit_distance(*m) for m in most]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.int64())], names=["doc_id", "near_id", "distance"])
            yield out.filter(pa.array([x is not None for x in d], pa.bool_()))

    return both.select("doc_id", "near_id", "text", "near_text").mapInArrow(released(verify), f"doc_id {kind}, near_id {kind}, distance bigint")
