"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from veilframe.llm import bpe, chat_quotes, decontaminate, html_extract, language, near_dedup, quality_rules, secrets, substring_dedup, token_files

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " end"), (None, "alpha beta gamma delta epsilon"), (7, "12345 !!"), (8, "é" * 70 + " 中文字 \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, component_id long"
    return spark.createDataFrame([(i, t, "en", None, 0, 9, None, 5) for i, t in ROWS], names)


@pytest.fixture(scope="module")
def vocabulary():
    from veilframe.llm.queries import TOKENIZERS

    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        return bpe.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), f.read()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_bpe(docs, vocabulary):
    assert {r.n_tokens for r in bpe.round_trip(docs, vocabulary[0]).where("doc_id IN (2, 3)").collect()} == {0}
    assert bpe.round_trip(docs, vocabulary[0]).count() == len(ROWS) and bpe.round_trip(docs.limit(0), vocabulary[0]).count() == 0
    back = bpe.decode(bpe.encode(docs, vocabulary[0]), vocabulary[0]).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted((i or 0, (t or "").encode()) for i, t in ROWS)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "beta gamma delta"), (None, None), (2, ""), (2, "beta gamma delta")], "item_id long, text string")
    found = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.without_leaks(docs, items).columns == docs.columns
    assert decontaminate.without_leaks(docs, items).count() == len(ROWS) - 3


def test_near_dedup(spark, docs):
    r = rows_of(near_dedup.near_duplicates(docs, 4))
    assert sorted(r, key=str) == sorted([(1, 2, 1, True)] * 2 + [(i, 0, i, True) for i in (2, 3, 4)] + [(5, 977, 5, True), (6, 978, 5, False), (None, 2, None, True), (7, 1, 7, True), (8, 1, 8, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 0, None), (1, None, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    lexicon, rules = quality_rules.learn(docs, labels)
    r = {x.doc_id: x for x in quality_rules.judge(docs, lexicon, rules).where("doc_id <> 1").collect()}
    assert r[2].base_failed and r[2].n_words == r[3].n_words == r[4].n_words == 0 and r[5].n_words == 30_000 and r[5].n_repeat_words == 30_000
    assert quality_rules.learn(docs, labels.limit(0)) == ([], []) and quality_rules.judge(docs.limit(0), [], []).count() == 0


def test_html(spark):
    d = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<p>a &amp; b<p>" + "c " * 50_000, "x")], "page_id long, url string, html string, text string")
    r = html_extract.extract(d).collect()
    assert sorted(x.n_chars for x in r) == [0, 0, 5 + 1 + 99_999] and html_extract.extract(d.limit(0)).count() == 0


def test_token_files(docs, vocabulary):
    files = token_files.write_tokens(docs, vocabulary[1])
    r = token_files.read_tokens(files).orderBy("start").collect()
    assert len(r) == len(ROWS) and [x.doc_id for x in r] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(r, r[1:])) and r[3].n_tokens == 1
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), vocabulary[1])).count() == 0
    with pytest.raises(KeyError):
        token_files.Reader(files.folder).get(999)


def test_language(docs):
    r = {x.doc_id: x for x in language.identify_all(docs).collect()}
    assert all(r[i].lang_pred == "und" and r[i].score == 0 for i in (2, 3, 4, 7)) and r[5].lang_pred == "en"
    assert {x.lang_pred for x in language.identify(docs, language.learn(docs.limit(0))).collect()} == {"und"}


def test_substring(docs):
    r = sorted(rows_of(substring_dedup.substring_dedup(docs, 3).select("doc_id", "n_words", "n_removed")), key=str)
    assert r == sorted([(1, 5, 5), (1, 5, 5), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 30_000, 30_000), (6, 30_001, 30_000), (None, 5, 5), (7, 2, 0), (8, 3, 0)], key=str)
    assert substring_dedup.substring_dedup(docs.limit(0), 3).count() == 0


def test_secrets(docs):
    assert {x.spans for x in secrets.scan(docs).collect()} == {""} and secrets.scan(docs.limit(0)).count() == 0
    assert rows_of(secrets.redact(docs).select("doc_id", "text")) == rows_of(docs.select("doc_id", "text"))


def test_chat(spark):
    d = spark.createDataFrame([(1, 0, None, "> x", 1), (1, 0, "u", None, 1), (None, 1, "u", "", 1), (2, None, "u", "x", 1), (1, 1, "u", "y " * 100_000, 1)], "conv_id long, turn long, role string, text string, depth int")
    r = chat_quotes.reply_order(d).collect()
    assert len(r) == 5 and {x.depth for x in r if x.turn == 1 and x.conv_id == 1} == {1} and chat_quotes.reply_order(d.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != "encode":
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        d = out
    assert {r.doc_id for r in d.collect()} == {1, 5, 8, None}
