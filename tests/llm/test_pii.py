import hashlib
import random
import re

from tidewater.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def _row(text):
    found = base_spans(text)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
    return (*(sum(x[3] == kind for x in found) for kind in BASE), hashlib.sha256(joined.encode()).hexdigest())


def _texts():
    rng = random.Random(8)
    parts = ["a@b.c", "é", "x_y%z@q-r.s.t", "a@b@c.d", "a@b.c_d@e.f", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.00255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (132) 555-1352", "+49 30 1234567", "+1 2", " ", "\n", "日本", "@", "+", "-", "7", "12", "000000000000", "\U0001f600", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    return texts + ["a" * 100_000, "1" * 20_000, "a@b" + ".c" * 20_000, "1." * 5_000, "+1" + "2 " * 5_000, "1 2-" * 5_000, None, ""]


def test_base_spans_equal_the_patterns(spark):
    texts = _texts()
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, "a@b.c", ""), (3, texts[3], "")], "doc_id long, text string, kind string")
    rows = P.pii_report(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = _row("a@b.c" if r["doc_id"] is None else texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want
    assert P.pii_report(df.limit(0)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(2)
    docs = []
    for k in range(40):
        docs.append((k, f"please write to agent{k}@mail.example today and reach host 10.0.0.{k} again"))
    docs.append((100, "please write to agent77 at mail today, write to agent7788 today"))
    docs.append((101, f"plain number {rng.randrange(10**6)} here and reach host node-7001-x again"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in P.pii_report(df).collect()}
    text = dict(docs)
    found = {d: [text[d][int(a) : int(b)] for _, a, b in (x.split(":") for x in r["spans"].split(","))] for d, r in rows.items() if r["n_found"]}
    assert found == {100: ["agent7788"], 101: ["node-7001-x"]}
    assert rows[100]["spans"].startswith("email:") and rows[101]["spans"].startswith("ip:")
    assert all(r["spans"] == f"email:16:{16 + len(f'agent{d}@mail.example')}" or r["n_ip"] == 1 for d, r in rows.items() if d < 40)


def _found(spark, docs):
    rows = P.pii_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    return {r["doc_id"]: sorted((x.split(":")[0], text[r["doc_id"]][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in r["spans"].split(",")) for r in rows if r["n_found"]}


def test_whole_spans_are_seeds(spark):
    names = ["ann", "bob", "cat", "dan", "eve", "fay", "gus", "hal", "ida", "jon"]
    docs = [(k, f"please call +1 (017) 555-77{k}3 now or contact {names[k]}@mail.example today") for k in range(10)]
    docs += [(100, "please call 0175 555 7713 now"), (101, "contact jane7788 today")]
    assert _found(spark, docs) == {100: [("phone", "0175 555 7713")], 101: [("email", "jane7788")]}


def test_tokens_without_digits_count_against_a_pattern(spark):
    names = ["ann", "bob", "cat", "dan", "eve", "fay", "gus", "hal"]
    docs = [(k, f"sent to {n}@mail.example") for k, n in enumerate(names)]
    docs += [(50 + k, f"went to {w}") for k, w in enumerate(["town", "sea", "bed", "work"])] + [(100, "went to 7001")]
    assert _found(spark, docs) == {}


def test_native(spark):
    plan = P.pii_report(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
