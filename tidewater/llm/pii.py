"""Personal data by bootstrapped contextual extraction (operator 5), DataFrame functions only.

Base patterns give seed entities. Then a word list and a pattern list feed each
other: the words around known entities are lexical patterns; a pattern is worth
the share of its tokens that are known or trusted; a token is worth the noisy-or
of its patterns; and so on for ``ROUNDS`` rounds over counts of (pattern, token)
pairs. Known are whole base matches, drawn out to white space, with what stands
around them; long hexadecimal keys are seeds of a kind of their own, ``secret``,
and spans of that kind. Tokens of an identifier's shape, and runs of numbers for phones and
cards, that stand in patterns of high worth are found too, under the kind of
their patterns. Tokens without a digit are never found, but count against the
patterns they stand in.

Java's expressions here are possessive where the greedy forms cannot give back
anything, and start only where a match can, so that long runs of one character
cost linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Seeds of this kind are no base spans.
SECRET_KIND = "secret"

#: Rounds of the bootstrapping.
ROUNDS = 3
#: Known tokens that a pattern must have, and the worth that makes patterns and tokens trusted.
LEAST_KNOWN, TRUSTED = 5, 0.8
#: Trusted patterns that may be broadcast.
BROADCAST_PATTERNS = 200_000

# The base patterns, of which some matches are dropped afterwards.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A match starts where a run of local characters does, or where the last match ended inside one.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NUMBER = r"[+(]?+[+(]?+[0-9][0-9().+-]*+"
#: A run of numbers or else a token with a digit: what bootstrapping may find.
TOKEN = rf"(?<![^\x20\x09-\x0D])(?:{_NUMBER}(?:\x20{_NUMBER})++(?![^\x20\x09-\x0D])|(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]++)"
#: A key in hexadecimal digits, of 128 bits at least.
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])"
_PATTERNS = {SECRET_KIND: SECRET, "email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "token": TOKEN}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + F.when(d.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == SECRET_KIND:
        return match.rlike("[0-9]") & match.rlike("[a-f]")
    return F.lit(True)


def _worth_looking(kind: str, text: Column) -> Column:
    """A cheap test that every match of the kind passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == SECRET_KIND:
        return text.rlike("[0-9a-f]{32}")
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}") if kind == "card" else text.rlike("[0-9]")


#: What stands around matches while a text is taken apart; in a text itself it becomes the other.
_MARK, _NO_MARK = "\x01", "\x02"
#: Digits of a token that can be found by its context.
LEAST_DIGITS = 4
_S, _W = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
# What is read on either side of a match: the two words before it and the one after, whole, and what touches it.
# Possessive, and begun at words only, so that runs of any length cost linear time.
_LEFT, _RIGHT = rf"(?<!{_S})(?:{_S}++{_W}++){{0,2}}{_S}*+\z", rf"\A{_S}*+(?:{_W}++{_S}++)?+"
_TOUCHES_LEFT, _TOUCHES_RIGHT = rf"(?<!{_S}){_S}++\z", rf"\A{_S}++"

_DOC = ["doc_id", "text_hash"]


def _hit(kind: str):
    def hit(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.char_length(x["p"]).cast("long").alias("gap"),
            x["m"].alias("match"),
            F.regexp_extract(x["p"], _LEFT, 0).alias("left"),
            F.regexp_extract(x["q"], _RIGHT, 0).alias("right"),
        )

    return hit


def _hits(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, start, end, match, left, right of all matches of all patterns.

    Places come from the lengths of the matches and of the pieces between
    them, summed in the order of each document's own matches.
    """
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.translate("text", _MARK, _NO_MARK).alias("text")).where(F.col("text").rlike("[0-9@+]"))
    each = []
    for kind, pattern in _PATTERNS.items():
        # pieces and matches take turns, so that one pass over the text gives both
        parts = F.split(F.regexp_replace("text", F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
        zipped = F.arrays_zip(parts.alias("p"), F.slice(parts, F.lit(2), F.size(parts)).alias("m"), F.slice(parts, F.lit(3), F.size(parts)).alias("q"))
        hits = F.transform(F.filter(zipped, lambda x, i: (i % 2 == 0) & x["m"].isNotNull()), _hit(kind))
        each.append(F.when(_worth_looking(kind, F.col("text")), hits))
    empty = F.array().cast("array<struct<kind:string,i:int,gap:bigint,match:string,left:string,right:string>>")
    found = rows.select(*_DOC, F.explode(F.concat(*[F.coalesce(x, empty) for x in each])).alias("hit")).select(*_DOC, "hit.*").distinct()
    w = Window.partitionBy(*_DOC, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("match")).over(w)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("match"))
    good = F.lit(False)
    for kind in _PATTERNS:
        good = F.when(F.col("kind") == kind, _passes(kind, F.col("match"))).otherwise(good)
    return found.where(good).select(*_DOC, "kind", "start", "end", "match", "left", "right")


# --- bootstrapping ---

_WORD = r"[^\x20\x09-\x0D]+"


def _contexts(tokens: DataFrame) -> DataFrame:
    """Each token with each of its lexical patterns: the word before, the two before, the words around."""
    before = F.lower(F.regexp_extract("left", rf"(?<!{_S})({_S}++){_W}++\z", 1))
    two = F.lower(F.regexp_extract("left", rf"(?<!{_S})({_S}++{_W}++{_S}++){_W}++\z", 1))
    after = F.lower(F.regexp_extract("right", rf"\A{_W}++({_S}++)", 1))
    named = F.array(
        F.when(before != "", F.concat(F.lit("1 "), before)),
        F.when(two != "", F.concat(F.lit("2 "), two)),
        F.when((before != "") & (after != ""), F.concat(F.lit("3 "), before, F.lit(" _ "), after)),
    )
    return tokens.withColumn("pattern", F.explode(F.filter(named, lambda x: x.isNotNull())))


def _others(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n_others): the distinct tokens without a digit, addresses apart, that stand in the patterns; one pass over the texts."""
    ws = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    at = lambda i: F.coalesce(F.get("ws", i), F.lit(""))
    each = F.transform("ws", lambda w, i: F.struct(w.alias("w"), at(i - 2).alias("two"), at(i - 1).alias("before"), at(i + 1).alias("after")))
    tokens = documents.select(ws.alias("ws")).select(F.explode(each).alias("t")).select("t.*").where((F.col("before") != "") & (F.col("w") != "") & ~F.col("w").rlike(rf"[0-9]|[{_LOCAL}]@[{_HOST}]+\.[{_HOST}]"))
    few = patterns.select("pattern").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_PATTERNS else few
    # the last word of what stands before, so that most tokens go at once
    last = few.select(F.regexp_extract("pattern", rf"^[123] (?:{_WORD}[\x20\x09-\x0D]+)??({_WORD})(?: _ {_WORD})?$", 1).alias("before")).distinct()
    tokens = tokens.join(last, "before", "left_semi")
    named = F.array(
        F.concat(F.lit("1 "), F.col("before")),
        F.when(F.col("two") != "", F.concat(F.lit("2 "), F.col("two"), F.lit(" "), F.col("before"))),
        F.when(F.col("after") != "", F.concat(F.lit("3 "), F.col("before"), F.lit(" _ "), F.col("after"))),
    )
    value = F.regexp_replace("w", r"^[^a-z]+|[^a-z]+$", "")
    pairs = tokens.select(value.alias("value"), F.explode(named).alias("pattern")).where("pattern is not null").join(few, "pattern", "left_semi")
    return pairs.distinct().groupBy("pattern").agg(F.count("*").alias("n_others"))


def trusted_patterns(tokens: DataFrame, rounds: int = ROUNDS, documents: DataFrame | None = None) -> DataFrame:
    """(pattern, kind, worth) of the patterns that are trusted after some rounds.

    ``tokens`` holds value, left, right and known, the kind of the base match
    in the token or null. All is counted over distinct (pattern, value) pairs.
    With ``documents`` the tokens without a digit count too: those that stand
    in patterns which would be trusted without them, as they can only lower
    the worth of patterns.
    """
    spark = tokens.sparkSession
    pairs = written(spark, _contexts(tokens).select("pattern", "value").distinct(), "pii-pairs")
    sizes = written(spark, pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_KNOWN), "pii-sizes")
    seeds = written(spark, tokens.where("known is not null").select("value", F.col("known").alias("kind")).distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    every = _rounds(pairs, sizes, seeds, rounds)
    if documents is None or every[-1].isEmpty():
        return every[-1]
    # more than this is trusted in no round
    most = written(spark, _others(documents, every[-1]), "pii-others")
    sizes = sizes.join(most, "pattern", "left").select("pattern", (F.col("n") + F.coalesce("n_others", F.lit(0))).alias("n"))
    return _rounds(pairs, sizes, seeds, rounds)[-1]


def _rounds(pairs: DataFrame, sizes: DataFrame, seeds: DataFrame, rounds: int) -> list[DataFrame]:
    """The trusted patterns after each round; scores never fall, so none is lost from one to the next."""
    spark = pairs.sparkSession
    scores, out = seeds, []
    for k in range(rounds):
        sums = pairs.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.sum((F.col("score") >= TRUSTED).cast("int")).alias("n_known"))
        worth = sums.join(sizes, "pattern").where(F.col("n_known") >= LEAST_KNOWN).select("pattern", "kind", (F.col("total") / F.col("n")).alias("worth"))
        out.append(written(spark, worth.where(F.col("worth") >= TRUSTED), "pii-trusted"))
        if k + 1 < rounds:
            # a value is worth the noisy-or of its trusted patterns; seeds stay certain
            found = pairs.join(out[-1], "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-6)))))).alias("score"))
            scores = found.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score"))
            scores = written(spark, scores, "pii-scores")
    return out


def _value(match: Column) -> Column:
    """A token without the punctuation around it."""
    return F.lower(F.regexp_replace(match, r"^[^0-9A-Za-z+]+|[^0-9A-Za-z]+$", ""))


def _apart(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens that overlap no base span; in the order of a document's own spans, each row looks at its neighbours."""
    both = tokens.withColumn("mine", F.lit(True)).unionByName(base.select(*_DOC, "start", "end").withColumn("mine", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*_DOC).orderBy("start", "mine", "end")
    reach = F.max(F.when(~F.col("mine"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(~F.col("mine"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = both.withColumn("reach", F.coalesce(reach, F.lit(-1).cast("long"))).withColumn("ahead", ahead)
    free = (F.col("reach") <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))
    return near.where(F.col("mine") & free).drop("mine", "reach", "ahead")


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, start, end (code points, end exclusive) and base of all spans.

    Base spans are all there, and so are long hexadecimal keys; a token that
    overlaps none of them is found if it has digits enough and stands in a
    trusted pattern. A run of numbers is found whole in patterns of phones and
    cards, in others its first.
    """
    spark = documents.sparkSession
    hits = written(spark, _hits(documents), "pii-hits")
    seeds = hits.where("kind <> 'token'")
    tokens = hits.where("kind = 'token'").select(*_DOC, "start", "end", "match", "left", "right").withColumn("value", _value(F.col("match")))
    tokens = _apart(tokens, seeds)
    # seeds are drawn out to white space; they stand for the tokens that they touch
    more, rest = F.regexp_extract("left", _TOUCHES_LEFT, 0), F.regexp_extract("right", _TOUCHES_RIGHT, 0)
    whole = seeds.select(*_DOC, "start", "end", F.concat(more, "match", rest).alias("match"), F.regexp_replace("left", _TOUCHES_LEFT, "").alias("left"), F.regexp_replace("right", _TOUCHES_RIGHT, "").alias("right"), F.col("kind").alias("known"))
    whole = whole.withColumn("value", _value(F.col("match")))
    tokens = written(spark, tokens.withColumn("known", F.lit(None).cast("string")).unionByName(whole), "pii-tokens")
    trusted = trusted_patterns(tokens, documents=documents)
    few = F.broadcast(trusted) if trusted.count() <= BROADCAST_PATTERNS else trusted
    unknown = _contexts(tokens.where(F.col("known").isNull())).join(few, "pattern")
    first = F.regexp_extract("match", rf"^{_WORD}", 0)
    unknown = unknown.withColumn("found", F.when(F.col("kind").isin("phone", "card"), F.col("match")).otherwise(first))
    unknown = unknown.where(F.length(_digits(F.col("found"))) >= LEAST_DIGITS).withColumn("end", F.col("start") + F.char_length("found"))
    found = unknown.groupBy(*_DOC, "start").agg(F.max_by(F.struct("kind", "end"), F.struct("worth", "kind", "end")).alias("best")).select(*_DOC, "start", "best.*")
    certain = seeds.select(*_DOC, "kind", "start", "end", (F.col("kind") != SECRET_KIND).alias("base"))
    return certain.unionByName(found.select(*_DOC, "kind", "start", "end").withColumn("base", F.lit(False)))


def pii_report(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The counts and the hash are of base spans; ``spans`` has all, ``n_found`` counts the others. A document is
    a (doc_id, text): rows alike in both give the same row each. Null and empty
    texts have no spans.
    """
    spark = documents.sparkSession
    order = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate((*KINDS, SECRET_KIND)) for x in (kind, k)]), F.col("kind"))
    all_spans = written(spark, spans(documents), "pii-spans")
    lists = all_spans.groupBy(*_DOC).agg(F.sort_array(F.collect_set(F.struct("start", order.alias("k"), "end", "kind", "base"))).alias("all"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "all")
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    empty = F.array().cast(lists.schema["all"].dataType)
    rows = rows.select("doc_id", F.coalesce("all", empty).alias("all")).withColumn("own", F.filter("all", lambda x: x["base"]))
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.col("own.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined("own"), 256).alias("base_sha256"), joined("all").alias("spans"), (F.size("all") - F.size("own")).cast("long").alias("n_found"))
