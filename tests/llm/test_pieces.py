import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm.bpe import default_vocabulary, encoder
from quillmap.llm.pieces import cut, merge, split_documents

E = encoder(default_vocabulary())


def check(text, limit, overlap):
    pieces = cut(text, E, limit, overlap)
    if not text:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert (len(pieces) == 1) == (len(E.encode(text)) <= limit)
    for before, (a, b, tokens, repeated) in zip([None, *pieces], pieces):
        assert tokens == len(E.encode(text[a:b])) <= limit
        if before:
            assert before[0] < a < before[1] < b
            assert 1 <= repeated <= overlap and repeated == len(E.encode(text[a : before[1]]))
    return pieces


@pytest.mark.parametrize("text", ["", "a", "word. " * 900, "a" * 4000, "日" * 900, "\n" * 900, " " * 900, "🇩🇪" * 400, "x1 " * 700, "é́" * 500, "CACTAGGAGCTTCCCGGG" * 60, "One.\n\nTwo, three; four\r\nfive " * 60])
def test_invariants(text):
    check(text, 64, 8)
    check(text, 1024, 64)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .,\n日é🇩1", max_size=300), st.sampled_from([(12, 4), (16, 5), (32, 8)]))
def test_any_text(text, sizes):
    check(text, *sizes)


def test_cuts_at_natural_boundaries():
    text = " ".join(f"Sentence number {i} ends here." for i in range(120))
    for a, b, _, _ in check(text, 64, 8)[:-1]:
        assert text[:b].rstrip().endswith(".")
    paragraphs = "\n\n".join("A line of words here.\nAnother line." for _ in range(40))
    assert all(paragraphs[:b].endswith("\n") for _, b, _, _ in check(paragraphs, 64, 8)[:-1])


def test_merge_takes_the_weakest_first():
    # Boundaries before units 1, 2, 3: the word boundary goes before the paragraph, which no longer fits.
    assert merge([4, 4, 4, 4], [5, 1, 5, 1], 10, 2) == [0, 2]
    assert merge([4, 4, 4], [5, 5, 1], 8, 0) == [0, 1]
    assert merge([4, 4, 4], [5, 5, 5], 100, 2) == [0]
    assert merge([9, 9], [5, 1], 10, 2) == [0, 1]


def test_documents(spark):
    long = "A sentence of some words. " * 400
    rows = [(1, long, 5), (1, long, 5), (2, None, 5), (3, "", 5), (4, "short", 5), (5, "z" * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_no int")
    got = split_documents(df).collect()
    assert {r["doc_id"] for r in got} == {1, 4, 5}
    assert sum(r["doc_id"] == 1 and r["piece_no"] == 0 for r in got) == 2
    assert {r["doc_id"] for r in split_documents(df, oversized_only=True).where("piece_no = 1").collect()} == {1, 5}
    assert all(r["piece"] == dict((a, b) for a, b, _ in rows)[r["doc_id"]][r["char_start"] : r["char_end"]] for r in got)
    assert split_documents(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split_documents(df, limit=10, overlap=10)
