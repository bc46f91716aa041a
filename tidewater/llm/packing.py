"""Best-fit packing planned on a histogram of lengths (operator 6).

One pass tokenizes the documents and leaves a small row for each piece. Pieces
are counted by length; best-fit decreasing runs over these counts (at most
``SEQUENCE`` lengths, whatever the number of documents) and places runs of
pieces of one length in runs of sequences. A piece then takes the slot of its
rank within its length. Ranks come from counts by bucket and length, so no
length, however common, is ever in one task.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.common import kept, released, small_batches, written

SEQUENCE = 2048
#: Ends each document.
END_ID = 0
#: Pieces in one bucket of the ranking, at least; more with the square root of all, so that buckets stay few too.
BUCKET = 2_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# The byte-level pattern of the vocabulary's pre-tokenizer without its alternative for white
# space before white space (see ``_parts``), and the characters that are white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{2,}}(?=[^{_SPACE}])")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if the vocabulary's merges go in the order of their ids, so that ids are ranks; else null."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if spec.get("normalizer") is not None or not level or model.get("type") != "BPE" or odd:
        return None
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    plain = {s: k for s, k in model["vocab"].items() if s not in special}
    if len(plain) != 256 + len(made) or [plain.get(s) for s in made] != list(range(256, 256 + len(made))):
        return None
    return {bytes(byte[c] for c in s): k for s, k in plain.items()}


class TextIds:
    """Ids of texts by a byte-level BPE vocabulary of the ``tokenizers`` library.

    Where ids are ranks, the same merges are made by ``tiktoken``, whose
    pattern needs no backtracking once texts are cut inside runs of white
    space; any other vocabulary goes through the library itself.
    """

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = self.encoding = None
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4") for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, names)).join("()")).split if names else lambda text: [text]
        if (ranks := _ranks(spec)) is None:
            self.library = Tokenizer.from_file(vocabulary)
        else:
            self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids as unsigned 32-bit numbers; the names of special tokens in a text are these tokens."""
        if self.library:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        each = []
        for x in self.split(text):
            if x in self.special:
                each.append(self.special[x])
            else:
                each += [self.encoding.encode_to_numpy(y) for y in _parts(x)]
        return each[0] if len(each) == 1 else np.concatenate(each)


def _parts(text: str) -> list[str]:
    """The text cut before the last character of each run of white space that text follows.

    The vocabulary's pattern leaves that character to what follows it and
    takes the others as one word, so words end there.
    """
    out, at = [], 0
    for m in _RUN.finditer(text):
        out.append(text[at : m.end() - 1])
        at = m.end() - 1
    return [*out, text[at:]]


def pieces(documents: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; whole texts, no shuffle.

    A document's ids end with ``END_ID``. Only a document of more than
    ``sequence`` ids is cut, and its first piece is the shorter one. A null
    text is empty and gives the one id; repeated rows give their pieces again.
    """
    small_batches(documents.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("packing", vocabulary), lambda: TextIds(vocabulary)).encode
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                ids = encode(text.as_py() or "").tobytes() + end
                n, at, i = len(ids) // 4, 0, 0
                while at < n:
                    stop = at + (n - at - 1) % sequence + 1
                    rows.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at, i = stop, i + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, first_rank, n, first_sequence, offset): the n pieces
    of that length from first_rank on go to n successive sequences, one each,
    at that offset. Lengths go from long to short; each piece goes to the
    fullest sequence that holds it, and sequences with as much room are taken
    together as a run, so the work follows the number of lengths, not pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs (first sequence, n)
    free: list[int] = []  # keys of room, ascending
    out, fresh = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, todo = 0, counts[size]
        while todo:
            at = bisect_left(free, size)
            if at < len(free):
                have = free[at]
                first, n = room[have].pop()
                if not room[have]:
                    del room[have]
                    free.pop(at)
            else:
                have, first, n = sequence, fresh, -(-todo // (sequence // size))
                fresh += n
            # a sequence that took a piece is the fullest, and so takes as many as it holds
            each = have // size
            full, more = divmod(min(todo, n * each), each)
            for k in range(each if full else 0):
                out.append((size, rank, full, first, sequence - have + k * size))
                rank += full
            for k in range(more):
                out.append((size, rank, 1, first + full, sequence - have + k * size))
                rank += 1
            put(have - each * size, first, full)
            if more:
                put(have - more * size, first + full, 1)
            used = full + (more > 0)
            put(have, first + used, n - used)
            todo = counts[size] - rank
    return out


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank, from 0, among the rows of the same length.

    Buckets by hash, ranks inside (bucket, length), and adds what smaller
    buckets hold of that length: windows over bounded groups only.
    """
    spark = rows.sparkSession
    total = rows.count()
    n = max(1, total // max(BUCKET, 4 * math.isqrt(total)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32"), F.col("length")]
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n))
    local = rows.withColumn("bucket", bucket).withColumn("local", F.row_number().over(Window.partitionBy("bucket", "length").orderBy(*order)) - 1)
    counts = written(spark, rows.withColumn("bucket", bucket).groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing-counts")
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    return local.join(before, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("before")).drop("bucket", "local", "before")


def pack(documents: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Sequences are gapless from 0 and hold at most ``sequence`` ids. An empty
    table gives no rows. What the driver sees is the count of each length, at
    most ``sequence`` rows; what it broadcasts is the plan over these.
    """
    spark: SparkSession = documents.sparkSession
    rows = written(spark, pieces(documents, vocabulary, sequence), "packing-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, sequence))
    cols = spark.sparkContext.broadcast(np.array(runs or [(0, 0, 0, 0, 0)], dtype=np.int64).T.copy())
    big = 1 << 44  # ranks stay under it: 17 trillion pieces of one length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, seq, offset = cols.value
        keys = size * big + first
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * big + rank, side="right") - 1
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(seq[at] + rank - first[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return _ranked(rows).mapInArrow(released(run), schema)
