import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tidewater.llm import token_counts as T

PIECES = T.read_pieces(T.default_model())
MODELS = {b: (T.CountModel(PIECES, byte_fallback=b), Tokenizer(models.Unigram(PIECES, 0, b))) for b in (True, False)}
PART = st.sampled_from(["a", "b", " ", "  ", "é", "日", "\U0001d518", "\U0001f600", "\n", "the", "ing", "▁", "qzx", "\x00"])


def _whole(tokenizer, text):
    return len(tokenizer.encode(text.replace(" ", T.SPACE), add_special_tokens=False).ids)


@pytest.mark.parametrize("fallback", [True, False])
@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=40))
def test_counts_equal_the_tokenizers(fallback, parts):
    text = "".join(parts)
    ours, theirs = MODELS[fallback]
    assert ours.count(text) == _whole(theirs, text)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc▁", min_size=1, max_size=4), st.integers(-6, 0), min_size=1, max_size=12), st.text("abcd ", max_size=25))
def test_ties_and_pieces_across_spaces(scores, text):
    pieces = [("<unk>", 0.0), *((p, float(s)) for p, s in scores.items())]
    ours, theirs = T.CountModel(pieces, byte_fallback=False), Tokenizer(models.Unigram(pieces, 0, False))
    assert ours.count(text) == _whole(theirs, text)


def test_query(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs).collect()}
    assert got == {k: _whole(MODELS[True][1], t) for k, t in texts.items()}
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (2, "a" * 50_000, "")], "doc_id long, text string, n_tokens string")
    rows = {r["n_tokens"] for r in T.token_counts(odd).collect()}
    assert rows == {0, 2, _whole(MODELS[True][1], "a" * 50_000)}
    assert T.token_counts(odd.limit(0)).count() == 0
