"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from retentia.llm import (
    chat, decontaminate, html_extract, lm_score, mixing, near_join, pii, quality_rules, toxicity,
    warc,
)

LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, _row int"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "s", 0),
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "s", 0),
    (None, "one two three four five six seven eight nine ten eleven", None, None, None, None, None),
    (2, None, "en", "a", 1, "s", 0),
    (3, "", "de", "b", 1, "s", 0),
    (4, " \t\n\x0b\x0c\r ", None, None, None, None, None),
    (5, "word", "en", "a", 1, "s", 0),
    (6, LONG, "en", "b", 1, "s", 0),
    (7, "mail me at ann.lee@example.com or ann.lee@example.com", "en", "c", 1, "s", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(spark, kind=DOCS):
    return spark.createDataFrame([], kind)


def test_near_copies(spark, docs):
    got = sorted(map(tuple, near_join.classes(docs).collect()), key=str)
    same = [r for r in got if r[2] == 2]
    assert sorted(str(r[0]) for r in same) == ["1", "1", "None"]
    assert {r[1] for r in same} == {1}
    assert [r for r in got if r[0] in (2, 3, 4, 5, 6, 7) and (r[1] != r[0] or r[2])] == []
    assert len(got) == len(ROWS)
    assert near_join.classes(empty(spark)).count() == 0
    kept = near_join.without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(ROWS) - 2
    assert near_join.without_copies(empty(spark)).count() == 0


def test_quality(spark, docs, labels):
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0 and by[2].base_failed
    assert by[6].n_words == 60_000 and by[6].kept
    assert by[5].base_failed and not by[5].kept
    assert quality_rules.judged(empty(spark), labels).count() == 0
    assert quality_rules.judged(docs, labels.limit(0)).count() == len(ROWS)


def test_toxicity(spark, docs, labels):
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.scored(docs, known).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1
    none = toxicity.scored(docs, known.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.scored(empty(spark), known).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_decontamination(spark, docs):
    items = "item_id long, text string, doc_id string, score int"
    bench = spark.createDataFrame(
        [(1, "Three four, five SIX seven eight. Nine ten!", "x", 1), (2, None, "x", 1),
         (3, "", None, None), (1, "Three four, five SIX seven eight. Nine ten!", "x", 1)], items)
    got = decontaminate.hits(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (None, 1)}
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0
    assert decontaminate.hits(empty(spark), bench).count() == 0
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontaminate.without_leaks(docs, bench.where("item_id > 1")).count() == len(ROWS)


def test_lm(spark, docs, labels):
    got = lm_score.scored(docs, labels.where("quality = 1").select("doc_id")).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].score is None and by[3].n_tokens == 0
    assert by[4].n_tokens == 0 and by[4].score is None and by[6].n_tokens == 60_000
    # repeated rows are each other's evidence, and so is the row without an id
    same = [r for r in got if r.n_tokens == 11]
    assert len(same) == 3 and by[1].score < by[6].score
    assert by[None].background_loss == pytest.approx(by[1].background_loss)
    twice = labels.where("quality = 1").select("doc_id")
    again = {r.doc_id: r.score for r in lm_score.scored(docs, twice.union(twice)).collect()}
    assert again[1] == pytest.approx(by[1].score)
    nothing = docs.where("doc_id IN (2, 3, 4)")
    assert [r.score for r in lm_score.scored(nothing, twice).collect()] == [None] * 3
    assert lm_score.scored(docs, labels.limit(0).select("doc_id")).count() == len(ROWS)
    assert lm_score.scored(empty(spark), labels.select("doc_id")).count() == 0


def test_mixing(spark, docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 4
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixed(docs.where("text is null")).first().taken == 0
    mix = mixing.sampled(docs)
    assert mix.agg(F.sum("words")).first()[0] == sum(r.taken for r in got)
    assert mixing.sampled(empty(spark)).count() == 0


def test_pii(spark, docs):
    out = pii.with_surrogates(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    same = {(a, b) for a, b, *_ in ROWS if a != 7}
    assert same <= got
    (text,) = [t for d, t in got if d == 7]
    first, second = text.removeprefix("mail me at ").split(" or ")
    assert first == second != "ann.lee@example.com" and first.count("@") == 1
    assert pii.with_surrogates(empty(spark)).count() == 0


PAGES = "page_id long, url string, html string, text string, host int"


def test_warc(spark):
    big = "<p>é" + "x" * 2000
    rows = [
        (1, "http://a/1", big, "t", 1), (2, "http://a/2 x\r\ny", big, "t", 1), (3, None, big, "t", 1),
        (3, None, big, "t", 1), (4, "http://b", None, None, None), (None, "http://c", big, "t", 1),
        (5, "http://d", "short\r\n\r\nWARC/1.1\r\n", "t", 1), (6, "http://e", "short", "t", 1),
    ]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = sorted(map(tuple, warc.round_trip(pages).select(
        "page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    n = len(big.encode())
    assert got == sorted([
        (1, n, "revisit", 3), (2, n, "revisit", 3), (3, n, "response", None),
        (3, n, "response", None), (4, 0, "response", None), (None, n, "revisit", 3),
        (5, 19, "response", None), (6, 5, "response", None)], key=str)
    assert warc.round_trip(empty(spark, PAGES)).count() == 0


def test_html(spark):
    rows = [
        (1, "http://a/1", "<article><h1>A</h1><p>b &amp; c\n d", "t", 1), (2, None, None, None, None),
        (2, "::", "", "t", 1), (3, "http://a/1", "<div>" * 3000 + "deep", "t", 1),
        (4, "http://a/1", "<p>" + "x " * 200_000, "t", 1),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    got = {(r.page_id, r.text[:20]) for r in html_extract.main_texts(pages).collect()}
    assert got == {(1, "A\nb & c d"), (2, ""), (3, "deep"), (4, "x " * 10)}
    assert html_extract.main_texts(empty(spark, PAGES)).count() == 0


TURNS = "conv_id long, turn int, role string, text string, turns string, formatted int"


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "b", "x", 1), (1, 1, "user", "a<|and|>", "x", 1),
        (1, 3, "assistant", None, "x", 1), (1, 3, "assistant", None, "x", 1),
        (None, None, None, "t", None, None), (2, 1, "assistant", "<|end|>\\1\\0</s>é", "x", 1),
        (3, 1, "user", "x" * 200_000, "x", 1),
    ]
    chats = chat.format_chats(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 1
    assert got[None].n_turns == 1
    assert got[2].loss_chars == len("<|end|>\\1\\0</s>é")
    assert got[3].loss_chars == 0
    assert chat.digests(chat.format_chats(empty(spark, TURNS))).count() == 0
