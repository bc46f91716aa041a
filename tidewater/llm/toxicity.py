"""Toxicity by multiple-instance learning (operator 4).

A document is a bag of sentences of which only the bag has a label. Each
sentence has a logistic score over its distinct words and their beginnings;
the document's score is their noisy-or, 1 - prod(1 - p). The weights are fitted to document labels by
gradient descent through the noisy-or, so a sentence's own score locates what
makes a document toxic.

The fit takes a bounded sample of labelled rows, ``SAMPLE`` of them by hash of
doc_id, and no more than ``FEATURES`` features; scoring takes every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import forget, released, small_batches, written
from tidewater.llm.decontaminate import words_of

#: Labelled rows that the fit reads, at most.
SAMPLE = 12_000
#: Words and beginnings of words with a weight, at most.
FEATURES = 4096
#: Code points of the beginnings that are features.
PREFIXES = (3, 4, 5, 6, 7)
#: Sample documents that a feature must stand in to get a weight.
LEAST_DOCS = 4
#: The least z score of a feature.
LEAST_Z = 3.0
#: One in this many ids is held out.
FOLDS = 5
STEPS = 300
RATE = 0.1
RIDGE = 1e-4
#: Words whose weight a worker keeps at hand.
KNOWN_WORDS = 400_000

#: A sentence ends after . ! ? and white space, or at a line's end.
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points; an empty text is one empty sentence."""
    text, out, at = text or "", [], 0
    for m in _ENDS.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text) or not out:
        out.append((at, len(text)))
    return out


def held_out(doc_id):
    """Whether an id belongs to the held-out fold (native); a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def features(word: bytes) -> list[bytes]:
    """A word's features: itself, and its beginnings marked by a star."""
    text = word.decode("utf-8")
    return [word, *(text[:n].encode() + b"*" for n in PREFIXES if n <= len(text))]


@dataclass
class Model:
    """Weights by feature and the score of a sentence without any."""

    weights: dict[bytes, float]
    bias: float

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias
        self.known: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        w = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self.known) < KNOWN_WORDS and len(word) <= 64:
            self.known[word] = w
        return w

    def logits(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The sentences and their logits."""
        text, known = text or "", self.known
        spans = sentences(text)
        z = []
        for a, b in spans:
            total = self.bias
            for word in set(words_of(text[a:b])):
                w = known.get(word)
                total += self.word(word) if w is None else w
            z.append(total)
        return spans, np.array(z)


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)), from the sum of softplus(z)."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def chosen_features(counts: list[tuple[bytes, int, int]], n_docs: int, n_toxic: int) -> list[bytes]:
    """The features (feature, documents, toxic documents) that tell most, by their z score."""
    rate = n_toxic / n_docs if n_docs else 0
    if not 0 < rate < 1:
        return []
    scored = [(abs(pos - both * rate) / math.sqrt(both * rate * (1 - rate)), f) for f, both, pos in counts if both >= LEAST_DOCS]
    return [f for z, f in sorted(scored, key=lambda x: (-x[0], x[1]))[:FEATURES] if z > LEAST_Z]


def fit(names: list[bytes], bags: list[tuple[int, int, list[list[int]]]]) -> Model:
    """Fit bags of (label, sentences without features, features of each other sentence, by place in names).

    Bags of no or only one label give a constant.
    """
    y = np.array([label for label, _, _ in bags], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, 5.0 if len(y) and y[0] else -30.0)
    plain = np.array([n for _, n, _ in bags], dtype=np.float64)
    doc = np.array([k for k, (_, _, bag) in enumerate(bags) for _ in bag], dtype=np.int64)
    size = [len(s) for _, _, bag in bags for s in bag]
    word = np.array([x for _, _, bag in bags for s in bag for x in s], dtype=np.int64)
    n = len(size)
    sent = np.repeat(np.arange(n), size)
    weights, bias = np.zeros(len(names)), -4.0
    mean = [np.zeros(len(names) + 1) for _ in range(2)]
    for t in range(1, STEPS + 1):
        z = bias + np.bincount(sent, weights[word], n)
        p = 1 / (1 + np.exp(-z))
        total = np.bincount(doc, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, bias)
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 700)), 1.0)
        g = p * pull[doc] / len(y)
        grad = np.append(np.bincount(word, g[sent], len(names)) + RIDGE * weights, g.sum() + (plain * pull).sum() / len(y) / (1 + np.exp(-bias)))
        mean[0] = 0.9 * mean[0] + 0.1 * grad
        mean[1] = 0.99 * mean[1] + 0.01 * grad**2
        step = RATE * (mean[0] / (1 - 0.9**t)) / (np.sqrt(mean[1] / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return Model({f: float(x) for f, x in zip(names, weights, strict=True)}, float(bias))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold.

    A doc_id with several labels counts as toxic if one says so; null labels
    and ids are left out; of texts with one id the least is read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    chosen = rows.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # of bounded size: `sample` rows of two numbers
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
    texts = written(spark, texts, "toxicity-sample")
    counts = texts.mapInArrow(released(_count_features), "feature binary, n bigint, n_toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    counts = written(spark, counts.where(F.col("n") >= LEAST_DOCS), "toxicity-features")
    n, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = toxic / n if n else 0
    z = F.abs(F.col("n_toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
    # the most telling ones, a fixed number of rows
    most = counts.where(z > LEAST_Z).orderBy(z.desc(), "feature").limit(2 * FEATURES).collect()
    names = chosen_features([(bytes(r["feature"]), r["n"], r["n_toxic"]) for r in most], n, toxic)
    place = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = place.value.get
        for b in batches:
            plain, out = [], []
            for text in b.column(0).to_pylist():
                bag = [bag_of(text[x:y], find) for x, y in sentences(text)] if text else [[]]
                plain.append(bag.count([]))
                out.append([s for s in bag if s])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(plain, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["label", "plain", "bag"])

    # rows of the sample, with the few words that have a feature
    bags = [tuple(r) for r in texts.mapInArrow(released(run), "label int, plain bigint, bag array<array<int>>").toLocalIterator()]
    place.destroy()
    forget(texts, counts)
    return fit(names, bags)


def bag_of(sentence: str, find) -> list[int]:
    """Places of the features of the sentence's distinct words, as often as words have them."""
    return [k for w in sorted(set(words_of(sentence))) for f in features(w) if (k := find(f)) is not None]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and toxic ones, in which a feature stands; summed over each batch."""
    for b in batches:
        both, pos = Counter(), Counter()
        for text, label in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True):
            found = {f for w in set(words_of(text)) for f in features(w)}
            both.update(found)
            if label:
                pos.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.binary()), pa.array(list(both.values()), pa.int64()), pa.array([pos[f] for f in both], pa.int64())], names=["feature", "n", "n_toxic"])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences and offending (flat start, end of sentences at 0.5 or more).

    Every whole text, no shuffle. Null and empty texts are one empty sentence;
    repeated rows are scored each; other columns are left out.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most FEATURES words
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(released(_scores(shared, rows.columns)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_sentences bigint, offending array<bigint>").select("doc_id", "score", "n_sentences", "offending")


def _scores(shared, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            score, n, bad = [], [], []
            for text in b.column(names.index("text")).to_pylist():
                spans, z = scorer.logits(text)
                score.append(noisy_or(z))
                n.append(len(spans))
                bad.append([x for k in np.flatnonzero(z >= 0) for x in spans[k]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(n, pa.int64()), pa.array(bad, pa.list_(pa.int64()))], names=["doc_id", "score", "n_sentences", "offending"])

    return run


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted, n_sentences, n_offending.

    Null and empty texts are one empty sentence and score what that scores; a
    null id is in no fold; repeated rows are scored each; an empty table gives
    no rows. Labels of no or one kind give all documents one score.
    """
    out = scored(documents, train(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", (F.size("offending") / 2).cast("long").alias("n_offending"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that score under 0.5, with their columns, whatever these are called.

    Null and empty texts go by the score of an empty sentence, which stays
    unless all labels are toxic; repeated rows stay or go together.
    """
    spark = documents.sparkSession
    model = train(documents, labels)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([noisy_or(scorer.logits(t)[1]) < 0.5 for t in texts], pa.bool_()))

    return documents.mapInArrow(released(run), documents.schema)
