import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmap.llm.bpe import default_vocabulary, encoder
from quillmap.llm.tokens import encode_corpus

REF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
REF.encode_special_tokens = True


def ref(text):
    return REF.encode(text, add_special_tokens=False).ids


HARD = [
    "<|endoftext|> is text", "a" * 3000, "ab" * 2000, "   \n\n  x  ", "1234567890" * 40, "don't I'LL we've'd", "🇩🇪👨‍👩‍👧", "\x85   ", "日本語テスト" * 60,
    "́" * 40, "\u0000\u0001", "Fluß straße ﬁn", "x² + ½≤∞ ∑wᵢ≥⁵⁄₈", " ", "\r\n\r\n", "naïve café " * 9, "ÿ" * 77,
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert encoder(default_vocabulary()).encode(text) == ref(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoder(default_vocabulary()).encode(text) == ref(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdest inglhtr", max_size=80))
def test_mergeable_text(text):
    e = encoder(default_vocabulary())
    assert e.encode(text) == ref(text) and e.count(text) == len(ref(text))


def test_every_token_is_its_own_encoding():
    e = encoder(default_vocabulary())
    assert all(e._encode(raw) == [token] for token, raw in e.bytes_of.items())


def test_corpus(spark):
    rows = [(1, "Hello world", [9]), (2, None, None), (3, "", []), (3, "", []), (None, "x", []), (4, "long " * 60_000, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted([(d, ref(t) if t else []) for d, t, _ in rows], key=repr)
    assert encode_corpus(df.where("false")).count() == 0
    assert encode_corpus(df).columns == ["doc_id", "ids"]


def test_corpus_equals_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["ids"] == (ref(text[r["doc_id"]]) if text[r["doc_id"]] else []) for r in encode_corpus(docs).collect())
