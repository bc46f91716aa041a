"""Licence scans by a trained paragraph classifier (operator 7), DataFrame functions on the main path.

Two kinds of paragraphs are read, each a bag of word n-grams. One is a line. The
other is a run of words between two blank lines, however many lines it goes
over and wherever it begins, as notices are wrapped or stand amid prose: for each
template and each number of its word pairs that is enough to confirm it, every
smallest run that has as many. A multinomial logistic
regression over sparse n-gram counts, trained here on notices made from the
templates below and on paragraphs that say no licence, gives each family a
probability; a temperature fitted on notices that training did not see
calibrates it, and what stays under ``CERTAIN`` is unknown. A family is then
confirmed only if the paragraph shares enough of its word pairs with one of the
family's templates. Of runs only confirmed ones count; paragraphs give way to
shorter ones within them that say the same, and of those that overlap the one that
shares most stays.

Training needs no corpus: its size is that of the templates, whatever the table.
"""

from __future__ import annotations

import random
import re
from functools import cache, reduce
from itertools import accumulate
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, written

#: Words in an n-gram, at most.
GRAMS = 3
#: The calibrated probability under which a paragraph's family is unknown.
CERTAIN = 0.6
#: The share of a template's word pairs that a paragraph must have.
SHARED = 0.6
#: What tells the words between two blank lines from others.
BLOCK = ["doc_id", "text_hash", "block"]
#: Made notices of each template, and made paragraphs without a licence for each of these.
VARIANTS, CLEAN = 24, 2
SEED = 7

# Families by SPDX identifier and short notices that name them.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "this program is free software under the terms of the gnu affero general public license"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "you may obtain a copy of the license at http www apache org licenses license 2.0", "spdx license identifier apache 2.0"],
    "BSD-2-Clause": ["licensed under the simplified bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "BSD-3-Clause": ["licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "BSL-1.0": ["distributed under the boost software license version 1.0"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC0-1.0": ["dedicated to the public domain under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "EPL-2.0": ["made available under the terms of the eclipse public license 2.0"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license version 2"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license version 3", "spdx license identifier gpl 3.0"],
    "ISC": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "spdx license identifier mit"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved unauthorized copying of this file is strictly prohibited", "proprietary and confidential"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
# Words put around notices, and phrases that look like notices and are none.
_AROUND = "this file project the is of and software work document code see for details please note part made by authors 2020 2021 copyright c text".split()
_NO_NOTICE = [
    "he lost his driving license last year", "the license plate was found on the road", "she has a license to teach", "rights of the reader are reserved for later chapters",
    "all seats are reserved for members", "permission to enter was granted by the guard", "the general public was invited to the meeting", "the software version 2.0 was released in may",
    "a copy of the letter was obtained", "the public domain of the river", "version 3 of the plan was approved", "licensed drivers may use the road", "the apache helicopter landed",
    "students of mit published the work", "the work is part of a series", "terms of the contract were read aloud", "the mozilla browser opened the page", "an eclipse was seen by the public",
]
#: Only lines with one of these are read: stems of notices, of which each template has one, and families' names.
_TRIGGERS = r"licen|copyright|permi|reserved|redistribut|public domain|proprietary|cc0|spdx|contributors may|creative commons|(?<![a-z])(?:[al]?gplv?|apache|mozilla|mpl|eclipse|epl|boost|bsd|isc|cc[ -]by)(?![a-z])"
#: Only runs of words with one of these are read. That passes no notice over: of each template's pairs, those
#: without any are fewer than ``SHARED`` asks for (one exception: "released under the" alone is no notice).
_STEMS = _TRIGGERS + r"|modif|distribut|hereby|software|binary|endorse|promote|neither|contributors|extent|waived|obtaining|documentation|unauthorized|prohibited|unencumbered|(?<![a-z])(?:gnu|commons|cc)(?![a-z])|general public|related rights|made available|the mit(?![a-z0-9])|subject to|source code|code form|released into"
#: The stems in a text as it is: any case, and whatever lies between two words.
_ANY = "(?i)" + _STEMS.replace("[ -]", " ").replace(" ", "[^a-z0-9]+")
_BLANK = r"\n[ \t-\r]*\n"
CLEAN_CLASS = "none"

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_JAVA_WORD = r"[a-z0-9]+(?:\.[0-9]+)*+"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(ws: list[str]) -> list[str]:
    return sorted({" ".join(ws[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(ws) - n + 1)})


def _variant(rng: random.Random, notice: list[str]) -> list[str]:
    """The notice with words around it and now and then one of its words gone or doubled."""
    out = list(notice)
    if len(out) > 5 and rng.random() < 0.4:
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [out[k], out[k]], [rng.choice(_AROUND)]])
    some = lambda n: [rng.choice(_AROUND) for _ in range(rng.randrange(n))]
    return some(8) + out + some(8)


def _clean(rng: random.Random) -> list[str]:
    """A paragraph without a licence: plain phrases, or words of notices out of order."""
    if rng.random() < 0.5:
        return words(rng.choice(_NO_NOTICE)) + [rng.choice(_AROUND) for _ in range(rng.randrange(6))]
    pool = [w for t in rng.sample(sorted(TEMPLATES), 3) for x in TEMPLATES[t] for w in words(x)]
    return [rng.choice(pool) for _ in range(rng.randrange(1, 10))]


def made_examples(seed: int, variants: int) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    out = [(family, _variant(rng, words(t))) for family, ts in TEMPLATES.items() for t in ts for _ in range(variants)]
    return out + [(CLEAN_CLASS, _clean(rng)) for _ in range(CLEAN * len(out))]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@cache
def train() -> dict:
    """Classes, biases and n-gram weights, already divided by the fitted temperature."""
    examples = made_examples(SEED, VARIANTS)
    classes = [*sorted(TEMPLATES), CLEAN_CLASS]
    bags = [grams(ws) for _, ws in examples]
    names = sorted({g for b in bags for g in b})
    place = {g: k for k, g in enumerate(names)}
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    col = np.array([place[g] for b in bags for g in b])
    y = np.zeros((len(bags), len(classes)))
    y[np.arange(len(bags)), [classes.index(c) for c, _ in examples]] = 1
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in bags])[:-1]))
    by_col = np.argsort(col, kind="stable")
    col_starts = np.concatenate(([0], np.flatnonzero(np.diff(col[by_col])) + 1))
    for t in range(300):
        p = _softmax(np.add.reduceat(w[col], starts, axis=0) + b)
        g = (p - y) / len(bags)
        rate = 8.0 / (1 + t / 100)
        w -= rate * (np.add.reduceat(g[row[by_col]], col_starts, axis=0) + 1e-4 * w)
        b -= rate * g.sum(axis=0)
    # the temperature that makes unseen notices likeliest
    unseen = made_examples(SEED + 1, VARIANTS // 3)
    z = np.array([b + sum((w[place[g]] for g in grams(ws) if g in place), np.zeros(len(classes))) for _, ws in unseen])
    right = np.array([classes.index(c) for c, _ in unseen])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean()
    heat = min((k / 10 for k in range(2, 60)), key=loss)
    keep = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    return {"classes": classes, "bias": (b / heat).tolist(), "weights": {names[k]: (w[k] / heat).tolist() for k in keep}, "heat": heat}


def _fixed_table(spark, rows: list[dict], schema: dict[str, pa.DataType]) -> DataFrame:
    """A small fixed table from rows of the driver, so that no row passes through Python on the executors.

    The rows must not be a literal: the driver keeps the text of each plan that has run, and it would hold them twice.
    It is written once, so that they aren't sent with the tasks of every plan that reads it.
    """
    return written(spark, spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(schema))).coalesce(1), "license-model")


def _grams(ws: Column, least: int, most: int) -> Column:
    """The distinct n-grams of an array of words (native)."""
    parts = [ws] + [F.slice(ws, F.lit(k + 1), F.greatest(F.size(ws), F.lit(1))) for k in range(1, most)]
    out = []
    for n in range(least, most + 1):
        named = [p.alias(f"w{k}") for k, p in enumerate(parts[:n])]
        out.append(F.transform(F.filter(F.arrays_zip(*named), _full(n)), _joined(n)))
    return F.array_distinct(F.concat(*out))


def _full(n: int):
    return lambda x: x[f"w{n - 1}"].isNotNull()


def _joined(n: int):
    return lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)])


def _same(a: str, b: str, cols: list[str]) -> Column:
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def _needed(pairs: int) -> int:
    """The least number of a template's pairs that confirms it."""
    return next(n for n in range(pairs + 1) if n >= SHARED * pairs)


def _templates(spark) -> DataFrame:
    """family, t, of, needed, k, pair: the word pairs of the templates."""
    listed = [(f, _pairs(words(x))) for f, ts in TEMPLATES.items() for x in ts]
    rows = [{"family": f, "t": t, "of": len(ps), "needed": _needed(len(ps)), "k": k, "pair": p} for t, (f, ps) in enumerate(listed) for k, p in enumerate(ps)]
    return _fixed_table(spark, rows, {"family": pa.string(), "t": pa.int32(), "of": pa.int32(), "needed": pa.int32(), "k": pa.int32(), "pair": pa.string()})


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, block, words, begins: what lies between blank lines and has a stem, and where its lines with words begin."""
    read = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").rlike(_ANY))
    read = read.select("doc_id", "text_hash", F.posexplode(F.split("text", _BLANK, -1)).alias("block", "part")).where(F.col("part").rlike(_ANY)).distinct()
    lines = F.transform(F.split(ascii_lower(F.col("part")), "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(_JAVA_WORD), F.lit(0)))
    placed = F.flatten(F.transform(lines, lambda x: F.transform(x, lambda w, k: F.struct(w.alias("w"), (k == 0).alias("first")))))
    placed = read.select(*BLOCK, placed.alias("x"))
    begins = F.filter(F.transform("x", lambda x, k: F.when(x["first"], k)), lambda k: k.isNotNull())
    return placed.select(*BLOCK, F.col("x.w").alias("words"), begins.alias("begins"))


def runs(found: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_hash, block, begin, end (exclusive): for each template and each number of its pairs that
    confirms it, all smallest runs of words with as many.

    The place at which each pair was met last gives, at every pair met, the latest begin for each number. No place
    lies in more runs of a template and a number than it has pairs, so their length as a whole grows as the text does.
    """
    after = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))
    each = found.select(*BLOCK, F.posexplode(F.zip_with("words", after, lambda a, b: F.concat_ws(" ", a, b))).alias("at", "pair"))
    most = max(len(_pairs(words(t))) for ts in TEMPLATES.values() for t in ts)
    so_far = Window.partitionBy(*BLOCK, "t").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = F.array(*[F.max(F.when(F.col("k") == k, F.col("at"))).over(so_far) for k in range(most)])
    met = each.join(F.broadcast(templates), "pair").select(*BLOCK, "t", "needed", "at", met.alias("met"))
    met = met.select(*BLOCK, "t", "needed", "at", F.sort_array(F.filter("met", lambda x: x.isNotNull()), asc=False).alias("met")).where(F.size("met") >= F.col("needed"))
    level = met.select(*BLOCK, "t", "at", F.posexplode(F.slice("met", F.col("needed"), F.size("met"))).alias("level", "begin"))
    least = level.groupBy(*BLOCK, "t", "level", "begin").agg(F.min("at").alias("at"))
    return least.select(*BLOCK, "begin", (F.col("at") + 2).alias("end")).distinct()


def paragraphs(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_hash, block, begin, end, line and words of all paragraphs that may be notices."""
    found = written(documents.sparkSession, blocks(documents), "license-blocks")
    said = lambda a, b: F.array_join(F.slice("words", a + 1, b - a), " ")
    ends = F.concat(F.slice("begins", F.lit(2), F.greatest(F.size("begins"), F.lit(1))), F.array(F.size("words")))
    spans = F.zip_with("begins", ends, lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
    lines = found.where(F.size("begins") > 0).select(*BLOCK, F.explode(F.filter(spans, lambda x: said(x["begin"], x["end"]).rlike(_TRIGGERS))).alias("x"))
    both = lines.select(*BLOCK, "x.*", F.lit(True).alias("line")).unionByName(runs(found, templates).withColumn("line", F.lit(False)))
    both = both.groupBy(*BLOCK, "begin", "end").agg(F.max("line").alias("line"))
    both = both.groupBy(*BLOCK).agg(F.collect_list(F.struct("begin", "end", "line")).alias("spans"))
    cut = F.transform("spans", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["line"].alias("line"), F.slice("words", x["begin"] + 1, x["end"] - x["begin"]).alias("words")))
    cut = found.alias("u").join(both.alias("v"), _same("u", "v", BLOCK)).select(*[F.col(f"u.{c}") for c in BLOCK], F.explode(cut).alias("x")).select(*BLOCK, "x.*")
    return cut.where(F.array_join("words", " ").rlike(_STEMS))


def notices(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, block, begin, end, line, family, probability, shared: the best class of each paragraph read,
    ``unknown`` where it is uncertain or no template confirms it, left out where it is none."""
    spark = documents.sparkSession
    model = train()
    key = [*BLOCK, "begin", "end", "line"]
    templates = _templates(spark)
    found = written(spark, paragraphs(documents, templates), "license-paragraphs")
    # of fixed size: the n-grams of the templates and what was made of them
    weights = F.broadcast(_fixed_table(spark, [{"gram": g, "w": w} for g, w in model["weights"].items()], {"gram": pa.string(), "w": pa.list_(pa.float64())}))
    each = found.select(*key, F.explode(_grams(F.col("words"), 1, GRAMS)).alias("gram")).join(weights, "gram")
    sums = [F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(model["classes"]))]
    scores = each.groupBy(*key).agg(*sums)
    z = [F.col(f"z{k}") + F.lit(b) for k, b in enumerate(model["bias"])]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    family = F.element_at(F.array(*[F.lit(c) for c in model["classes"]]), F.array_position(F.array(*z), top).cast("int"))
    best = scores.select(*key, family.alias("family"), (1 / total).alias("probability")).where(F.col("family") != CLEAN_CLASS)
    # the share of each template's word pairs that the paragraph has
    own = found.select(*key, F.explode(_grams(F.col("words"), 2, 2)).alias("pair")).join(F.broadcast(templates), "pair")
    shared = own.groupBy(*key, "family", "t", "of").agg(F.count("*").alias("n")).groupBy(*key, "family").agg(F.max(F.col("n") / F.col("of")).alias("shared"))
    both = best.alias("b").join(shared.alias("s"), _same("b", "s", [*key, "family"]), "left")
    sure = (F.col("probability") >= CERTAIN) & (F.coalesce("shared", F.lit(0.0)) >= SHARED)
    units = both.select(*[F.col(f"b.{c}") for c in key], F.when(sure, F.col("b.family")).otherwise("unknown").alias("family"), "probability", F.coalesce("shared", F.lit(0.0)).alias("shared"))
    return _best(written(spark, units.where("line or family <> 'unknown'"), "license-units"))


def _best(units: DataFrame) -> DataFrame:
    """The units that stay; each meets only what begins within it or shares a word with it."""
    at = F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("at")
    key = [*BLOCK, "begin", "end"]
    # units that say no more than shorter ones within them go
    u, v = units.where("family <> 'unknown'").select("*", at).alias("u"), units.alias("v")
    inside = (F.col("u.at") == F.col("v.begin")) & F.expr("v.end <= u.end and v.end - v.begin < u.end - u.begin and v.shared >= u.shared")
    idle = u.join(v, _same("u", "v", [*BLOCK, "family"]) & inside).select(*[F.col(f"u.{c}") for c in key]).distinct()
    left = written(units.sparkSession, units.alias("u").join(idle.alias("v"), _same("u", "v", key), "left_anti"), "license-least")
    # a unit stays where it is the best on each of its words
    rank = F.struct((F.col("family") != "unknown").alias("known"), "shared", (F.col("begin") - F.col("end")).alias("short"), (-F.col("begin")).alias("early"))
    ranked = left.select("*", rank.alias("rank"), at)
    best = ranked.groupBy(*BLOCK, "at").agg(F.max("rank").alias("best"))
    lost = ranked.alias("u").join(best.alias("v"), _same("u", "v", [*BLOCK, "at"])).where("u.rank <> v.best").select(*[F.col(f"u.{c}") for c in key]).distinct()
    return left.alias("u").join(lost.alias("v"), _same("u", "v", key), "left_anti")


def _pairs(ws: list[str]) -> list[str]:
    return sorted({" ".join(x) for x in zip(ws, ws[1:], strict=False)})


def license_report(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, families (sorted, comma-joined, unknown left out), n_notices, n_unknown.

    Null and empty texts have no notices. Rows alike in doc_id and text get
    the same row each; a null doc_id is an id like any other.
    """
    found = notices(documents).groupBy("doc_id", "text_hash").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))), ",").alias("families"),
        F.count(F.when(F.col("family") != "unknown", 1)).alias("n_notices"),
        F.count(F.when(F.col("family") == "unknown", 1)).alias("n_unknown"),
    )
    found = found.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_notices", zero).alias("n_notices"), F.coalesce("n_unknown", zero).alias("n_unknown"))


def _brute_windows(ws: list[str], template: list[str]) -> set[tuple[int, int]]:
    """The smallest windows with each number of a template's word pairs that confirms it."""
    wanted, out = set(_pairs(template)), set()
    has = [(k, p) for k, p in enumerate(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)) if p in wanted]
    for n, (start, first) in enumerate(has):
        seen = set()
        for end, pair in has[n:]:
            if end > start and pair == first:
                break
            if pair not in seen:
                seen.add(pair)
                if len(seen) >= SHARED * len(wanted):
                    out.add((start, end + 2))
    return out


def brute_families(text: str | None) -> list[str]:
    """The families of a text, a paragraph at a time in Python; for tests."""
    model, out = train(), []
    for block in re.split(_BLANK, (text or "").translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))):
        lines = [_WORD.findall(x) for x in block.split("\n")]
        ws = [w for x in lines for w in x]
        ends = list(accumulate(map(len, lines)))
        spans = {(e - len(x), e): True for e, x in zip(ends, lines, strict=True) if re.search(_TRIGGERS, " ".join(x))}
        for t in (words(t) for ts in TEMPLATES.values() for t in ts):
            for a, b in _brute_windows(ws, t):
                if re.search(_STEMS, " ".join(ws[a:b])):
                    spans.setdefault((a, b), False)
        units = []
        for (a, b), line in spans.items():
            found = [g for g in grams(ws[a:b]) if g in model["weights"]]
            if not found:
                continue
            p = _softmax((np.array(model["bias"]) + sum(np.array(model["weights"][g]) for g in found))[None])[0]
            family = model["classes"][int(p.argmax())]
            if family == CLEAN_CLASS:
                continue
            share = max(len(set(_pairs(ws[a:b])) & set(_pairs(words(t)))) / len(_pairs(words(t))) for t in TEMPLATES[family])
            if p.max() >= CERTAIN and share >= SHARED:
                units.append((family, share, a, b))
            elif line:
                units.append(("unknown", share, a, b))
        left = [u for u in units if not any(v[0] == u[0] and v[3] - v[2] < u[3] - u[2] and v[1] >= u[1] and u[2] <= v[2] and v[3] <= u[3] for v in units)]
        rank = lambda u: (u[0] != "unknown", u[1], u[2] - u[3], -u[2])
        out += [u[0] for u in left if not any(rank(v) > rank(u) and v[2] < u[3] and u[2] < v[3] for v in left)]
    return out
