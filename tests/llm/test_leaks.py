import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm.displayed import displayed_words
from quillmap.llm.leaks import MASKS, Seeds, leaked_passages, leaks, overlaps

PASSAGE = "When twelve boats of Felmu crossed loloish water the passage at Petor fell quolaned under one roof"
ITEMS = "item_id long, passage string, stem string, doc_id long"


def test_displayed_words():
    want = ["the", "volotiish", "café", "finds", "häuser"]
    for text in ("The Volotiish café finds Häuser", "<p>The</p> VOLO-\ntiish <b>ca</b>f&eacute;, &#102;inds <br/>H&auml;user!", "the​ volo­tiish café ﬁnds häuser", "ＴＨＥ **volo**tiish café \x1b[31mfinds\x1b[0m häuser", "the\r\n> volo-\r\n> tiish\tcafé finds <!-- no --> häuser"):
        assert displayed_words(text) == want
    assert displayed_words("сrossed") == ["crossed"] and displayed_words("совет") == ["совет"]
    assert displayed_words(None) == displayed_words("") == displayed_words(" .,\n") == []
    assert displayed_words("a < b and c > d &unknown; 3 &") == ["a", "b", "and", "c", "d", "unknown", "3"]


def brute(words, item, run):
    grams = {tuple(item[i : i + run]) for i in range(len(item) - run + 1)}
    return any(tuple(words[i : i + run]) in grams for i in range(len(words) - run + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=40), st.data())
def test_search_is_exhaustive(text, item, data):
    if item and data.draw(st.booleans()):
        a = data.draw(st.integers(0, len(item)))
        text = text[:20] + item[a : a + data.draw(st.integers(0, 20))] + text[20:]
    text, item = np.array(text, np.int64), np.array(item, np.int64)
    hits = [h for d in range(-len(item), len(text)) for h in overlaps(text, item, d, Seeds(MASKS).offsets())]
    assert any(h[0] >= 12 for h in hits) == brute(list(text), list(item), 12)
    for run, matched, length, start in hits:
        grams = {tuple(item[i : i + run]) for i in range(len(item) - run + 1)}
        assert tuple(text[start : start + run]) in grams and run <= matched <= length <= 2 * matched


def test_masks_fit_a_run():
    assert all(len(m) <= 12 and m[0] == m[-1] == "1" and "0" in m for m in MASKS)


@pytest.fixture(params=["sent", "joined"])
def form(request, monkeypatch):
    """Both forms of the join, whatever the number of words."""
    if request.param == "joined":
        monkeypatch.setattr("quillmap.llm.leaks.SENT_WORDS", -1)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 99) for i, t in texts], "doc_id long, text string, item_id int")


def test_leaks(spark, form):
    w = PASSAGE.split()
    texts = [
        (1, "Intro. " + PASSAGE.upper() + " end"), (2, " ".join(w[2:14])), (3, " ".join(w[2:13])), (4, None), (5, ""), (6, "  "),
        (7, " ".join(w[:6] + ["other"] + w[7:])), (8, "x " * 100_000 + PASSAGE), (9, "<p>" + " ".join(f"<i>{x}</i>" for x in w) + "</p>"), (9, PASSAGE), (10, " ".join(w[:11]) + " " + " ".join(w[:11])),
    ]
    items = spark.createDataFrame([(50, PASSAGE, "s", 1), (51, PASSAGE, "", 2), (52, None, "s", 3), (53, "", "s", 4), (54, "too short", "s", 5)], ITEMS)
    got = {tuple(r) for r in leaks(docs_of(spark, texts), items).collect()}
    assert got == {(d, i) for d in (1, 2, 8, 9) for i in (50, 51)}
    tolerant = {r["doc_id"]: (r["run"], r["matched"], r["length"]) for r in leaked_passages(docs_of(spark, texts), items).where("item_id = 50").collect()}
    assert tolerant[7] == (10, 16, 17) and tolerant[3][0] == 11
    assert leaks(docs_of(spark, []), items).count() == 0
    assert leaks(docs_of(spark, texts), items.where("false")).count() == 0


def test_many_items(spark, monkeypatch, form):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(words, k=25)) for _ in range(20)]
    texts = [(i, " ".join(rng.choices(words, k=15)) + " " + (" ".join(passages[i % 20].split()[5:17]) if i % 3 else "none") + " end") for i in range(60)]
    items = spark.createDataFrame([(i, p, "", 0) for i, p in enumerate(passages)], ITEMS)
    want = {(i, n) for i, t in texts for n, p in enumerate(passages) if brute(t.split(), p.split(), 12)}
    monkeypatch.setattr("quillmap.llm.leaks.CHUNK_WORDS", 100)
    monkeypatch.setattr("quillmap.llm.leaks.PAIRS", 7)
    assert {tuple(r) for r in leaks(docs_of(spark, texts), items).collect()} == want


@pytest.mark.parametrize("run", [5, 20])
def test_other_runs(spark, run):
    w = PASSAGE.split()
    items = spark.createDataFrame([(1, PASSAGE + " " + PASSAGE[::-1], "", 0)], ITEMS)
    texts = docs_of(spark, [(1, " ".join((w + PASSAGE[::-1].split())[:run])), (2, " ".join(w[: run - 1] if run < 10 else w))])
    assert {r["doc_id"] for r in leaks(texts, items, run=run).collect()} == {1}


def test_short_texts_of_characters_that_stand_for_several_words(spark, form):
    text = "\ufdfa " * 3
    assert len(text) == 6 and len(displayed_words(text)) >= 12
    items = spark.createDataFrame([(1, text, "", 0)], ITEMS)
    assert [tuple(r) for r in leaks(docs_of(spark, [(5, text)]), items).collect()] == [(5, 1)]


def test_one_passage_in_many_items_and_documents(spark, monkeypatch, form):
    monkeypatch.setattr("quillmap.operators.joins.PAIRS", 100_000)
    n = 3000
    items = spark.range(n).selectExpr("id AS item_id", f"'{PASSAGE}' AS passage", "'' AS stem", "id AS doc_id")
    texts = spark.range(n).selectExpr("id AS doc_id", f"concat('report ', id % 7, ' says: {PASSAGE}.') AS text", "0 AS item_id")
    found = leaks(texts, items)
    assert tuple(found.selectExpr("count(*)", "sum(doc_id)", "sum(item_id)").first()) == (n * n, n * n * (n - 1) // 2, n * n * (n - 1) // 2)


def test_ids_with_several_texts_and_null_ids(spark, form):
    items = spark.createDataFrame([(1, PASSAGE, "", 0), (1, PASSAGE.upper() + " again", "", 0), (None, PASSAGE, "", 0)], ITEMS)
    texts = docs_of(spark, [(5, PASSAGE), (5, "so: " + PASSAGE + " again"), (None, PASSAGE), (6, PASSAGE), (6, PASSAGE)])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["run"], r["start"]) for r in leaked_passages(texts, items).collect())
    n = len(PASSAGE.split())
    assert got == [(-1, 1, n, 0), (5, 1, n + 1, 1), (6, 1, n, 0)]
