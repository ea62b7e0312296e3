import json
import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators.models import FixedLogit
from riskloom.operators.ordering import with_row
from riskloom.operators.scaling import Scaler
from riskloom.plans.scoring import score_batch
from riskloom.schema import EXPORT, FEATURES
from riskloom.sources import files
from riskloom.sources.artifacts import load_artifacts, read_report, status


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_good_and_quarantined_rows(spark, tmp_path):
    path = write(
        tmp_path / "in",
        "a.csv",
        "Time,V1,Amount,Class,note\n"
        "0,1.5,10.0,0,x\n"
        "1,,NA,1,y\n"
        "2,abc,5,0,z\n"
        "3,1\n"
        "4,1,2,0,u,extra\n"
        "5,nan,1e2,1,v\n",
    )
    good, bad = files.read_transactions(spark, path)
    rows = {r["Time"]: r for r in good.collect()}
    assert set(rows) == {0.0, 1.0, 5.0}
    assert (rows[1.0]["V1"], rows[1.0]["Amount"], rows[1.0]["Class"]) == (None, None, 1)
    assert (rows[5.0]["V1"], rows[5.0]["Amount"], rows[5.0]["V28"]) == (None, 100.0, 0.0)
    assert "note" not in good.columns
    reasons = sorted((r["record"].split(",")[0], r["reason"]) for r in bad.collect())
    assert reasons == [
        ("2", "not a number: V1"), ("3", "wrong number of fields"), ("4", "wrong number of fields"),
    ]
    assert (good.count(), bad.count()) == (3, 3)


def test_strict_reading_raises(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", "Time,Amount\n1,oops\n")
    with pytest.raises(ValueError, match="not a number: Amount"):
        files.read_transactions(spark, path, strict=True)
    path = write(tmp_path / "none", "a.csv", "Time,Amount\n")
    with pytest.raises(ValueError, match="empty"):
        files.read_transactions(spark, path, strict=True)


def test_only_csv_files_count(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", "Time,Amount\n1,2\n")
    write(folder, "B.CSV", "Time,Amount\n3,4\n")
    path = write(folder, "c.txt", "Time,Amount\n5,6\n")
    good, _ = files.read_transactions(spark, path)
    assert sorted(r["Time"] for r in good.collect()) == [1.0, 3.0]


def test_numbers_follow_file_and_line_order(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", "Time,Amount\n" + "".join(f"{i},1\n" for i in range(50)))
    path = write(folder, "b.csv", "Time,Amount\n" + "".join(f"{i},1\n" for i in range(50, 80)))
    write(folder, "c.csv", "Time,Amount\n80,1\n81,oops\n82,1\n")
    good, bad = files.read_transactions(spark, path, positions=True)
    rows = with_row(good).collect()
    assert len(rows) == 82
    assert all(r["row"] == r["Time"] + 1 for r in rows if r["Time"] < 81)
    (odd,) = bad.collect()
    assert odd["record"] == "81,oops" and odd["tx_id"]["file"].endswith("c.csv")


def test_rows_of_a_scored_file(spark, tmp_path):
    """Row numbers of many small blocks are the line numbers of the input."""
    folder = tmp_path / "in"
    text = "Time,Amount\n" + "".join(f"{i},{-1 if i == 500 else 1}\n" for i in range(3_000))
    path = write(folder, "a.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        good, _ = files.read_transactions(spark, path, positions=True)
        assert good.rdd.getNumPartitions() > 5
        unit = Scaler({"Amount": 0.0, "Time": 0.0}, {"Amount": 1.0, "Time": 1.0})
        scored, rejected = score_batch(good, FixedLogit(0.0, {"Time": 1e-3}), unit)
        by_row = {r["row"]: r["fraud_probability"] for r in scored.collect()}
        assert rejected.first()["row"] == 501
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert set(by_row) == set(range(1, 3_001)) - {501}
    p = lambda t: round(1 / (1 + math.exp(-t / 1000)), 4)
    assert all(abs(by_row[t + 1] - p(t)) < 1.1e-4 for t in range(3_000) if t != 500)


def test_parquet_input(spark, tmp_path, separable):
    path = str(tmp_path / "p")
    separable.write.parquet(path)
    good, bad = files.read_transactions(spark, path, "parquet")
    assert (good.count(), bad.count()) == (384, 0)
    assert good.columns == ["tx_id", "Class", *FEATURES]


def test_export_to_several_places(spark, tmp_path):
    row = (1, 2.5, 81.0, 0.81, "FRAUD", "HIGH")
    names = "row long, amount double, risk_score double, fraud_probability double, label string, confidence string"
    df = spark.createDataFrame([row], names).withColumn("other", F.lit(1))
    paths = [str(tmp_path / "x"), str(tmp_path / "y")]
    files.write_scored(df, *paths)
    for path in paths:
        assert tuple(files.read_scored(spark, path).first()) == row
    text = next((tmp_path / "x").glob("*.csv")).read_text().splitlines()
    assert text == [",".join(EXPORT), "1,2.5,81.0,0.81,FRAUD,HIGH"]


def test_json_defaults_and_rejects(spark):
    lines = spark.createDataFrame(
        [('{"Amount": 3.5, "V2": 1}',), ('{"V1": 1}',), ('{"Amount": -2}',), ("not json",)], "value string"
    )
    valid, rejected = files.parse_json_transactions(lines)
    (row,) = valid.collect()
    assert (row["Amount"], row["V2"], row["V3"], row["Time"]) == (3.5, 1.0, 0.0, 0.0)
    reasons = sorted(r["reject_reason"] for r in rejected.collect())
    assert reasons == ["amount missing", "amount missing", "negative amount"]


JSON_LINES = {
    '{"tx_id": 1, "Amount": 3.5, "V2": 1}': None,
    '{"tx_id": 2, "Amount": 3.5, "V2": null}': "no value for V2",
    '{"tx_id": 3, "Amount": 3.5, "V2": "oops", "V3": true}': "not a number: V2,V3",
    '{"tx_id": 4, "Amount": "much"}': "not a number: Amount",
    '{"tx_id": 5, "Amount": null}': "amount missing",
    '{"tx_id": 6, "Amount": -2}': "negative amount",
    '{"tx_id": 7, "Amount": 1, "V4": {"a": 1}}': "not a number: V4",
    '{"tx_id": 8, "V1": 1}': "amount missing",
    '{"tx_id": "x", "Amount": 1}': "not a number: tx_id",
    "not json": "amount missing",
}


def test_json_gaps_and_wrong_types_are_rejected_with_their_line(spark):
    lines = spark.createDataFrame([(x,) for x in JSON_LINES], "value string")
    valid, rejected = files.parse_json_transactions(lines)
    assert [(r["tx_id"], r["V2"], r["V3"]) for r in valid.collect()] == [(1, 1.0, 0.0)]
    got = {r["record"]: r["reject_reason"] for r in rejected.collect()}
    assert got == {k: v for k, v in JSON_LINES.items() if v}


def test_json_lines_are_parsed_once_whatever_is_filtered(spark, tmp_path):
    """A filter on judged rows holds no copy of the parsing, and gives the rows that it names."""
    lines = spark.createDataFrame([(x,) for x in [*JSON_LINES, None]], "value string")
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    valid, rejected = files.parse_json_transactions(lines)
    chosen = files.judge_json(lines).filter("V2 = 0.0 AND Amount > 0.5 AND tx_id > 6")
    for df in (valid, rejected, chosen):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r["tx_id"] for r in valid.collect()] == [1]
    reasons = {r["record"]: r["reject_reason"] for r in rejected.collect()}
    assert reasons == {None: "amount missing", **{k: v for k, v in JSON_LINES.items() if v}}
    assert [(r["tx_id"], r["_reason"]) for r in chosen.collect()] == [(7, "not a number: V4")]


def test_stream_keeps_scored_and_rejected_rows(spark, tmp_path):
    from riskloom.plans import registry
    from riskloom.streaming import live

    lines = spark.createDataFrame([(x,) for x in JSON_LINES], "value string")
    lines.write.text(str(tmp_path / "json"))
    unit = Scaler({"Amount": 0.0, "Time": 0.0}, {"Amount": 1.0, "Time": 1.0})
    rows = registry._live_json(spark, str(tmp_path / "json"), str(tmp_path / "rows"), unit)
    assert [r["tx_id"] for r in live.scored_rows(rows).collect()] == [1]
    got = {r["record"]: r["reject_reason"] for r in live.rejected_rows(rows).collect()}
    assert got == {k: v for k, v in JSON_LINES.items() if v}

    columns = f"tx_id long, {', '.join(f'{c} double' for c in FEATURES)}"
    made = [(i, *[0.0] * 29, a) for i, a in ((1, 2.0), (2, -1.0), (3, None))]
    spark.createDataFrame(made, columns).write.parquet(str(tmp_path / "in"))
    totals = registry._live_totals(spark, str(tmp_path / "in"), str(tmp_path / "all"), unit)
    assert totals.first()["total_rows"] == 1
    left_out = live.rejected_rows(spark.read.parquet(str(tmp_path / "all"))).collect()
    assert {r["tx_id"]: r["reject_reason"] for r in left_out} == {2: "negative amount", 3: "no value for Amount"}


def test_no_artifacts(spark, tmp_path):
    assert read_report(spark, str(tmp_path / "none")).count() == 0
    row = status(spark, str(tmp_path / "none")).first()
    assert (row["status"], row["model_loaded"], row["model_name"]) == ("ok", False, None)
    with pytest.raises(FileNotFoundError, match="Train a model first"):
        load_artifacts(spark, str(tmp_path / "none"))


def test_indented_report_file(spark, tmp_path):
    metrics = {"model": "a", "accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0, "roc_auc": 0.9}
    report = {"best_model": "a", "best_roc_auc": 0.9, "feature_names": ["Time"], "all_metrics": [metrics]}
    (tmp_path / "metrics.json").write_text(json.dumps(report, indent=2))
    row = read_report(spark, str(tmp_path / "metrics.json")).first()
    assert row.asDict(recursive=True) == report


def test_bad_label_is_quarantined(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Amount,V1,Class\n1,2,banana\n3,4,1\n")
    good, bad = files.read_transactions(spark, str(tmp_path))
    assert [r["Amount"] for r in good.collect()] == [3.0]
    assert "Class" in bad.first()["reason"]


def test_text_that_is_no_number_is_not_scored(spark):
    from riskloom.plans.scoring import judge

    df = spark.createDataFrame([(1, "5", "oops"), (2, "6", "1.5")], "tx_id long, Amount string, V1 string")
    reasons = {r["tx_id"]: r["reject_reason"] for r in judge(df).collect()}
    assert reasons == {1: "not a number: V1", 2: None}


def test_scoring_json_compiles(spark, tmp_path):
    """The JVM leaves methods of 8,000 bytes and more uncompiled: no expression per feature makes one."""
    from riskloom.plans import registry
    from riskloom.streaming import live

    spark.createDataFrame([('{"Amount": 3.5}',)], "value string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    scaler = Scaler({"Amount": 1.0, "Time": 1.0}, {"Amount": 2.0, "Time": 2.0})
    scored = live.score_and_reject(files.judge_json(lines), registry._logit(), scaler, {})
    code = scored._jdf.queryExecution().debug().codegenToSeq()
    assert code.size() and all(code.apply(i)._3().maxMethodCodeSize() < 8_000 for i in range(code.size()))
