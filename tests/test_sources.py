"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import panel, participants
from lectern.sources import readers, writers


def schema(text):
    return StructType.fromDDL(text)


@pytest.fixture()
def raw(tmp_path):
    header = "part,speechId,paragraphId,sentenceId,wordId,word,word_first_fix_dur,number_of_fixations\n"
    for stem, rows in {"P01": ["P01,45,0,0,0,tak,120,1", "P01,45,0,0,1,om,,0", "P01,1327,0,0,0,practice,99,1"], "p2": ["2,45,0,0,0,tak,150,3", "2,45,0,0,1,om,110,"]}.items():
        (tmp_path / f"{stem}.csv").write_text(header + "\n".join(rows) + "\n")
    return tmp_path


RAW = "part string, speechId int, paragraphId int, sentenceId int, wordId int, word string, word_first_fix_dur double, number_of_fixations int"


def test_observation_scan_to_measures(spark, raw):
    rows = readers.observation_csvs(spark, f"{raw}/*.csv", schema(RAW)).withColumn("text_id", F.col("speechId").cast("string"))
    kept = participants.exclude_listed(rows)
    assert kept.count() == 4 and {r.participant_id for r in kept.select("participant_id").distinct().collect()} == {"P01", "P02"}
    mapped = panel.map_measures(kept, {"FFD": "word_first_fix_dur", "fixation_count": "number_of_fixations"}, {"landing_position": "landing"})
    got = {(r.participant_id, r.wordId): (r.FFD, r.skip, r.refixation_count, r.landing_position) for r in mapped.collect()}
    assert got[("P01", 0)] == (120.0, 0, 0.0, None) and got[("P01", 1)] == (None, 1, 0.0, None) and got[("P02", 0)][2] == 2.0


def test_optional_csv(spark, tmp_path):
    columns = schema("subj string, label int")
    assert readers.optional_csv(spark, str(tmp_path / "none.csv"), columns).count() == 0
    (tmp_path / "some.csv").write_text("subj,label\nP01,1\n")
    assert readers.optional_csv(spark, str(tmp_path / "some.csv"), columns).first().label == 1


def test_tsv_with_mark_and_missing_columns(spark, tmp_path):
    (tmp_path / "IA_P1.txt").write_text("﻿SESSION\tIA_ID\tDWELL\nP1\t1\t2,5\n", encoding="utf-8")
    rows = readers.tsv_columns(spark, f"{tmp_path}/IA_*.txt", ["SESSION", "DWELL", "ABSENT"])
    assert rows.columns == ["SESSION", "DWELL"] and rows.first().SESSION == "P1"


def test_table_set_shards_and_reports(spark, tmp_path):
    writers.write_tables({"words": spark.range(3)}, str(tmp_path))
    assert readers.table_set(spark, str(tmp_path), ["words"])["words"].count() == 3
    for i in range(2):
        spark.createDataFrame([(f"w{i}", 1.5)], "word_id string, score double").coalesce(1).write.parquet(f"{tmp_path}/lm/s{i}/surprisal_shard{i}.parquet")
    shards = readers.sharded_scores(spark, f"{tmp_path}/lm", "lm", name_filter="*.parquet")
    assert shards.count() == 2 and shards.columns == ["word_id", "lm_score"]
    report = {"status": "passed", "reports": [
        {"context_id": "a", "status": "ok", "warnings": [], "errors": [], "word_count": 3, "token_count": 4},
        {"context_id": "b", "status": "error", "warnings": ["w"], "errors": ["e", "e"], "word_count": 1, "token_count": 1}]}
    (tmp_path / "alignment_report_shard0.json").write_text(json.dumps(report))
    flat = readers.alignment_reports(spark, str(tmp_path))
    counts = {(r.kind, r.value): r["count"] for r in readers.report_counts(flat).collect()}
    assert counts == {("status", "ok"): 1, ("status", "error"): 1, ("warning", "w"): 1, ("error", "e"): 2}
    assert readers.report_examples(flat).first().errors == "e;e"


def test_stage_reuse_and_first_available(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(2)

    path = str(tmp_path / "stage")
    assert writers.read_or_build(spark, path, build).count() == 2
    assert writers.read_or_build(spark, path, build).count() == 2 and len(calls) == 1
    assert readers.first_available(spark, [str(tmp_path / "no"), path], build).count() == 2 and len(calls) == 1
    assert readers.first_available(spark, [str(tmp_path / "no")], build).count() == 2 and len(calls) == 2
    with pytest.raises(FileExistsError):
        writers.refuse_non_empty(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "text_id string, v int")
    writers.write_tables({"t": df}, str(tmp_path), partition_by=["text_id", "absent"])
    assert (tmp_path / "t.parquet" / "text_id=a").exists()
    writers.write_report_csv(df, [str(tmp_path / "x"), str(tmp_path / "y")], "report")
    assert spark.read.option("header", True).csv(str(tmp_path / "y" / "report")).count() == 2
