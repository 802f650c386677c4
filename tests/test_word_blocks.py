"""Words scored beside their text equal words joined with their pairs, and do not move."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import word_blocks
from lectern.plans import corpus_features

ODD = [(1, "A cat sat. a CAT ran!\nOne only . ! - A cat"), (2, ""), (3, None), (4, " \n . .. \n"), (5, "ø Ø 1 # # #.  x İ ß"), (6, "cat " * 300), (-7, "sat cat. A")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_dealt_words_equal_joined_words_and_do_not_move(spark, monkeypatch):
    texts = spark.createDataFrame(ODD, "doc_id long, text string")
    want = rows(corpus_features.word_features(texts))
    monkeypatch.setattr(word_blocks, "SMALL", 0)
    out = corpus_features.word_features(texts)
    assert rows(out) == want
    moved = [line for line in plan(out).splitlines() if "Exchange " in line and "SinglePartition" not in line]
    assert moved and all("shufflepartitionidpassthrough" in line or "hashpartitioning(doc_id" in line for line in moved)  # the ids are counted
    assert "HashJoin" not in plan(out) and "SortMergeJoin" not in plan(out)
    empty = texts.where("doc_id = 3")
    assert corpus_features.word_features(empty).collect() == []


def test_dealt_texts_need_ids_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "SMALL", 0)
    texts = spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, text string")
    with pytest.raises(Exception, match="an id is null or not unique"):
        corpus_features.word_features(texts).collect()


def test_parts_grow_with_the_texts(spark, monkeypatch):
    texts = spark.createDataFrame(ODD, "doc_id long, text string")
    assert word_blocks.parts_of(texts) == 0
    monkeypatch.setattr(word_blocks, "SMALL", 0)
    monkeypatch.setattr(word_blocks, "PART", 10)
    size = texts.agg(F.sum(F.length("text"))).first()[0]
    assert word_blocks.parts_of(texts) == -(-size // 10)


def test_sentences_combine_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "SMALL", 0)
    texts = spark.createDataFrame(ODD, "doc_id long, text string")
    shown = plan(corpus_features.prepared_sentences(corpus_features.word_features(texts)))
    assert "partial_avg" in shown and "REPARTITION_BY_COL" not in shown


@pytest.mark.parametrize("name", ["j15_corpus_sentence_table", "j15_corpus_text_table", "j04_j13_corpus_family_report", "g03_sentence_surprisal"])
def test_queries_over_dealt_texts_equal_those_over_joined_words(spark, monkeypatch, name):
    from lectern.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = rows(QUERIES[name](spark, folder))
    monkeypatch.setattr(word_blocks, "SMALL", 0)
    out = QUERIES[name](spark, folder)
    assert "FlatMapCoGroupsInArrow" in plan(out) and rows(out) == want


def test_repeated_ids_share_their_sentences(spark, monkeypatch, tmp_path):
    from lectern.queries import QUERIES

    texts = [(1, "a b. c"), (1, "a b b"), (None, "a b"), (None, "b a")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = rows(QUERIES["g03_sentence_surprisal"](spark, str(tmp_path)))
    monkeypatch.setattr(word_blocks, "SMALL", 0)
    assert rows(QUERIES["g03_sentence_surprisal"](spark, str(tmp_path))) == want
