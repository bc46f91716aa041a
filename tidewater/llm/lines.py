"""Line dedup by range-partitioned hashes (operator 3), DataFrame functions only.

One pass over the texts writes the 128-bit hashes of the lines' keys. Counts by
hash, combined before the shuffle, leave the hashes that stand on enough lines;
their rows are range-partitioned by (hash, document) and sorted by document and
position, so that even the most common line is spread over partitions, and the
first row of each hash in each document streams out of that order and is
counted. What comes back is a bitmap of kept lines for each document, never
text: 64 lines to a word, words in which all lines stay left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, forget, written

#: Documents in which a line must stand to be dropped.
LEAST_DOCS = 10
#: Code points of a key, at least.
LEAST_CHARS = 1
#: Hashes (16 bytes each) that may be broadcast; above that Spark shuffles for the join.
BROADCAST_KEYS = 500_000
# The white space stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"

_DOC = ["doc_id", "text_hash"]


def lines_of(text):
    """The lines of a text as an array; null and empty texts are one empty line (native)."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    """What makes lines equal (native)."""
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def _text_hash(text):
    return F.xxhash64(text)


def hashed_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, pos and the two hashes of each line whose key is long enough."""
    split = documents.select("doc_id", _text_hash(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = split.select(*_DOC, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select(*_DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("tidewater"), F.col("key")).alias("h2"))


def _checked(keys: DataFrame) -> DataFrame:
    """Keys of a written table, to be broadcast only if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")


def first_in_documents(lines: DataFrame) -> DataFrame:
    """The first row (h1, h2, doc_id, text_hash, pos) of each hash in each document.

    Rows are dealt by ranges of (hash, document) and sorted by document and
    position; the window streams over that order and adds no exchange.
    """
    by = ["h1", "h2", "doc_id"]
    ranges = lines.select(*by, "text_hash", "pos").repartitionByRange(*by).sortWithinPartitions(*by, "text_hash", "pos")
    return ranges.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("text_hash", "pos"))).where("nth = 1").drop("nth")


def keep_bitmaps(documents: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """Bitmaps of the documents that lose lines: doc_id, text_hash, keep_words.

    A line is dropped if its key stands in at least ``least_docs`` documents;
    with ``keep_first`` its first line, by doc_id (null first), text hash and
    position, stays. A word of ``keep_words`` is (word, keep): bit i of keep is
    set if line 64 * word + i stays; words not listed keep all their lines.

    Rows of one doc_id are one document here, whatever their texts, and null
    is an id like any other; each row has its own lines, so bitmaps go by
    (doc_id, text hash). Keys differ unless 128 bits agree.
    """
    spark = documents.sparkSession
    lines = written(spark, hashed_lines(documents, least_chars), "lines-hashes")
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("h1", "h2")
    often = written(spark, often, "lines-often")
    some = first_in_documents(lines.join(_checked(often), ["h1", "h2"], "left_semi"))
    keys = some.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*_DOC, "pos")).alias("first_line")).where(F.col("n") >= least_docs).drop("n")
    keys = written(spark, keys, "lines-keys")
    gone = lines.join(_checked(keys), ["h1", "h2"])
    if keep_first:
        gone = gone.where(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first_line")))
    words = gone.groupBy(*_DOC, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    words = words.withColumn("entry", F.struct("word", F.bitwise_not("drop").alias("keep")))
    # an array of a document's own words, at most a 64th of its lines
    bitmaps = written(spark, words.groupBy(*_DOC).agg(F.sort_array(F.collect_list("entry")).alias("keep_words")), "lines-bitmaps")
    forget(lines, often, keys)
    return bitmaps


def dropped_positions(keep_words):
    """The positions that a bitmap drops, ascending (native)."""
    bits = F.transform(
        keep_words,
        lambda w: F.filter(F.sequence(w["word"] * 64, w["word"] * 64 + 63), lambda p: F.getbit(w["keep"], p % 64) == 0),
    )
    return F.flatten(bits)


def _with_lines(documents: DataFrame, bitmaps: DataFrame, carried: list) -> DataFrame:
    """Each row with its lines and the array of positions dropped, null for none."""
    rows = documents.select(*carried, F.col("doc_id").alias("_doc"), _text_hash(F.col("text")).alias("_hash"), lines_of(F.col("text")).alias("_lines"))
    marks = bitmaps.select(F.col("doc_id").alias("_doc2"), F.col("text_hash").alias("_hash2"), "keep_words")
    joined = rows.join(marks.hint("merge"), F.col("_doc").eqNullSafe(F.col("_doc2")) & F.col("_hash").eqNullSafe(F.col("_hash2")), "left")
    return joined.withColumn("_dropped", dropped_positions(F.col("keep_words")))


def _kept_text():
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    return F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")


def line_report(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_lines, n_dropped, kept_sha256.

    Null and empty texts have one empty line, which is never dropped; a text
    that loses all its lines is empty; an empty table gives no rows.
    """
    rows = _with_lines(documents, keep_bitmaps(documents, least_docs), ["doc_id"])
    text = F.when(F.col("_dropped").isNull(), F.array_join("_lines", "\n")).otherwise(_kept_text())
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


def drop_lines(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows of ``documents``, with their columns, without repeated lines.

    The first line of each key stays, so one copy of every line is left. Null
    texts stay null; ``n_chars``, where there is such a column, is counted again
    where lines went.
    """
    names = documents.columns
    # the text travels once, as its lines
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_row")
    rows = _with_lines(documents, keep_bitmaps(documents, least_docs, keep_first=True), [F.col("text").isNull().alias("_null"), rest])
    text = F.when(F.col("_dropped").isNull(), F.array_join("_lines", "\n")).otherwise(_kept_text())
    rows = rows.withColumn("_text", F.when(~F.col("_null"), text))
    out = []
    for c in names:
        col = F.col("_text") if c == "text" else F.col("_row").getField(c)
        if c == "n_chars":
            col = F.when(F.col("_dropped").isNull(), col).otherwise(F.char_length("_text").cast(documents.schema[c].dataType))
        out.append(col.alias(c))
    return rows.select(*out)


#: The same as DuckDB SQL; a row of the table by its number, as ids may repeat.
ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, u.i - 1 AS pos, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u
), often AS (
  SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10
), m AS (
  SELECT l.*, (o.key IS NOT NULL) AS gone FROM l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
