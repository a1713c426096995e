import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import queries, token_counts
from tests.conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "  ", "a", " a", "a ", " a  b   ", "▁", "a▁b ▁", "<s> </s> <unk>", "<0x0A>", "\n\t x", "\0", "😀 é ﬁ 　", "x" * 3000,
       "word " * 2000, "<|endoftext|>", "   \n   ", "​ ﻿"]


def test_word_memo_is_exact():
    count = token_counts.piece_counter(MODEL)
    assert count(ODD) == [len(PLAIN.encode(t)) for t in ODD]
    assert count.__name__ == "count", "this model can be counted by words"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab<s>\nthe"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_memo_on_any_text(text):
    assert COUNT([text]) == [len(PLAIN.encode(text))]


COUNT = token_counts.piece_counter(MODEL)


def test_cache_is_used_and_appended(spark, rows, tmp_path, monkeypatch):
    pairs = [(1, "one text"), (2, "one text"), (3, None), (3, None), (None, "other"), (5, "word " * 3000)]
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts.token_counts(rows(pairs), cache, MODEL, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), len(PLAIN.encode(t or "")), len(PLAIN.encode(t or "")) > 100) for i, t in pairs]
    assert sorted(r[:4] for r in map(tuple, first)) == sorted(want) if None not in [p[0] for p in pairs] else \
        sorted((r[:4] for r in first), key=str) == sorted(want, key=str)
    assert spark.read.parquet(cache).count() == 4
    more = rows([*pairs, (9, "new one")])
    assert token_counts.token_counts(more, cache, MODEL, limit=100).count() == 7
    assert spark.read.parquet(cache).count() == 5, "only the new text was encoded"
    # a stored count is taken as it is
    spark.createDataFrame([(token_counts.tokenizer_digest(MODEL), __import__("hashlib").sha256(b"planted").hexdigest(), 77)],
                          token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert token_counts.token_counts(rows([(1, "planted")]), cache, MODEL).first().n_tokens == 77
    other = public_tokenizers.path("byte_bpe_50k.json")
    want = len(Tokenizer.from_file(other).encode("planted", add_special_tokens=False).ids)
    assert token_counts.token_counts(rows([(1, "planted")]), cache, other).first().n_tokens == want
    assert token_counts.token_counts(rows([]), cache, MODEL).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(PLAIN.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
