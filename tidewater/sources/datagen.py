"""The demo table: deterministic in its seed, generated in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.sources.parquet import WriteOptions, write_parquet

# Fixed values of the table: rows in a chunk, keys, vector width, null rates, and which rows are special.
CHUNK_ROWS = 65_536
KEYS, WIDTH, STRINGS = 100, 8, 13
NULL_KEY_EVERY, NULL_VALUE_EVERY, SPECIAL_EVERY = 50, 40, 16
SPECIAL = np.array([0x7FF8000000000000, 0x8000000000000000, 0, 0x7FF0000000000000, 0xFFF0000000000000, 0xFFF8000000000000], dtype=np.uint64).view(np.float64)
# Fixed values of the generator: SplitMix64, and what spreads chunks over its states.
STEP, MIX_A, MIX_B, CHUNK_STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F

SCHEMA = "id bigint, k bigint, v double, s string, emb array<float>"


def draws(state: int, n: int) -> np.ndarray:
    """The next n numbers of the generator: each is a function of its place, so all come at once."""
    z = np.uint64(state) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def chunk(first: int, rows: int, seed: int, special_floats: bool = False) -> pa.RecordBatch:
    """The rows from id ``first`` on, which must start a chunk."""
    r = draws((seed ^ (first * CHUNK_STEP)) & (2**64 - 1), rows * (2 + WIDTH)).reshape(rows, 2 + WIDTH)
    ids = np.arange(first, first + rows, dtype=np.int64)
    high = r >> np.uint64(8)
    k = (high[:, 0] % np.uint64(KEYS)).astype(np.int64)
    v = ((high[:, 1] & np.uint64(0xFFFFFFFF)) % np.uint64(100)).astype(np.float64) / 4
    no_v = r[:, 1] % np.uint64(NULL_VALUE_EVERY) == 0
    if special_floats:
        at = ids % SPECIAL_EVERY == 0
        v[at] = SPECIAL[ids[at] // SPECIAL_EVERY % len(SPECIAL)]
        no_v &= ~at
    emb = (r[:, 2:] % np.uint64(2000)).astype(np.float32) / np.float32(100) - np.float32(10)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            pa.array(k, mask=r[:, 0] % np.uint64(NULL_KEY_EVERY) == 0),
            pa.array(v, mask=no_v),
            pa.array([f"s{x}" for x in (ids % STRINGS).tolist()]),
            pa.ListArray.from_arrays(np.arange(0, rows * WIDTH + 1, WIDTH, dtype=np.int32), emb.ravel()),
        ],
        names=["id", "k", "v", "s", "emb"],
    )


def demo_table(spark: SparkSession, rows: int = 1_000_000, seed: int = 42, special_floats: bool = False) -> DataFrame:
    """The table as a frame; a task makes whole chunks."""
    chunks = -(-rows // CHUNK_ROWS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                yield chunk(c * CHUNK_ROWS, min(CHUNK_ROWS, rows - c * CHUNK_ROWS), seed, special_floats)

    return spark.range(chunks).mapInArrow(make, SCHEMA)


def write_demo_table(spark: SparkSession, path: str, rows: int = 1_000_000, seed: int = 42, special_floats: bool = False, options: WriteOptions | None = None) -> int:
    """Write the table with Bloom filters on id and k; the number of rows."""
    return write_parquet(demo_table(spark, rows, seed, special_floats), path, options or WriteOptions(bloom_columns=["id", "k"]))
