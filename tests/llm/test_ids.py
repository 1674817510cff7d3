"""No operator loses rows, changes ids that floats cannot hold, or stumbles over columns named like its own."""

import pytest

pytest.importorskip("wayfind.llm")
from wayfind.llm import html_text, line_dedup, lm_score, near_dedup, toxicity, url_filter

BIG = 2**53 + 1
ROWS = [(BIG, "one two three four five six seven"), (None, "one two three four five six seven"), (BIG + 2, "others say nothing of that kind at all"), (BIG + 4, None)]
IDS = sorted(((i, t) for i, t in ROWS), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "a", "b", "c") for r in ROWS], "doc_id long, text string, _cut int, _k string, _t string, _of string")


def test_near_dedup_keeps_every_row(docs):
    got = near_dedup.near_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == IDS and {(r["_cut"], r["_k"], r["_t"]) for r in got} == {(1, "a", "b")}
    assert {r["component_id"] for r in got} == {BIG, None, BIG + 2, BIG + 4}


def test_toxicity_keeps_ids(spark, docs):
    got = toxicity.score_toxicity(docs, spark.createDataFrame([(BIG, 1), (BIG + 2, 0), (BIG + 6, 1)], "doc_id long, toxic int")).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, BIG, BIG + 2, BIG + 4]


def test_lines_keep_columns(docs):
    got = line_dedup.dedup_lines(docs, min_docs=2).collect()
    assert {(r["_cut"], r["_k"], r["_t"], r["_of"]) for r in got} == {(1, "a", "b", "c")}
    assert sorted(((r["doc_id"], r["kept"]) for r in got), key=repr) == sorted([(BIG, ""), (None, ""), (BIG + 2, ROWS[2][1]), (BIG + 4, "")], key=repr)


def test_pages_keep_ids_and_columns(spark):
    rows = [(BIG, "http://h.org/a", "<p>One</p>", [BIG], "x"), (None, "http://h.org/b", "<p>Two</p>", None, "x"), (BIG + 2, None, None, [1], "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, _low array<bigint>, _host string")).collect()
    assert {(r["page_id"], r["text"], tuple(r["_low"] or ()), r["_host"]) for r in got} == {(BIG, "One", (BIG,), "x"), (None, "Two", (), "x"), (BIG + 2, "", (1,), "x")}


def test_urls_keep_columns(spark):
    got = url_filter.filter_urls(spark.createDataFrame([(BIG, "http://h.org/a", "s", "r", "t"), (None, None, "s", "r", "t")], "page_id long, url string, shape string, _r string, rejected string")).collect()
    assert {(r["page_id"], r["shape"], r["_r"], r["rejected"]) for r in got} == {(BIG, "s", "r", "t"), (None, "s", "r", "t")}


def test_scores_follow_how_often_words_occur(spark):
    """Fitted to occurrences: of two halves of equally many words, the one said a hundred times as often is the likelier."""
    texts = [(i, "lopado lopado lopado lopado lopado") for i in range(100)] + [(1000, "temacho")]
    out = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[0]["score"] / 6 > out[1000]["score"] / 2
