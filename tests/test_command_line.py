import json

import pytest

from riskloom.__main__ import main
from riskloom.schema import EXPORT, FEATURES


def test_train_score_report(spark, learnable, tmp_path, capsys, monkeypatch):
    from riskloom.operators import models
    from riskloom.plans import training

    monkeypatch.setattr(training, "candidates", lambda: models.candidates(trees=10, rounds=2))
    data, artifacts, out = (str(tmp_path / x) for x in ("data", "artifacts", "scored"))
    learnable.drop("tx_id").orderBy("Time").coalesce(1).write.option("header", True).csv(data)
    main(["train", "--data", data, "--out", artifacts])
    assert "best model:" in capsys.readouterr().out

    main(["score", "--data", data, "--artifacts", artifacts, "--out", out, out + "2"])
    scored = spark.read.option("header", True).csv(out)
    assert scored.columns == EXPORT and scored.count() == 1_600
    assert {int(r["row"]) for r in scored.select("row").collect()} == set(range(1, 1_601))

    main(["report", "--scored", out + "2", "--out", str(tmp_path / "report"), "--label", "fraud"])
    summary = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert summary["total_rows"] == 1_600
    assert 60 <= summary["fraud_count"] <= 140
    assert spark.read.json(str(tmp_path / "report" / "top")).count() == 20

    main(["score-one", "--artifacts", artifacts, json.dumps({"Amount": 5, **{f"V{i}": -2 for i in range(1, 29)}})])
    assert json.loads(capsys.readouterr().out)["label"] == "FRAUD"
    main(["status", "--artifacts", artifacts])
    assert "true" in capsys.readouterr().out


def test_empty_input_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Amount,Class\n")
    with pytest.raises(ValueError, match="empty"):
        main(["train", "--data", str(tmp_path), "--out", str(tmp_path / "out")])


def test_mix(spark, separable, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "mixes")
    separable.write.parquet(data)
    main(["mix", "--data", data, "--format", "parquet", "--out", out, "--", "known_fraud", "stolen_card"])
    df = spark.read.option("header", True).csv(out + "/stolen_card")
    assert df.columns == FEATURES and df.count() == 30
    assert spark.read.option("header", True).csv(out + "/known_fraud").count() == 10
