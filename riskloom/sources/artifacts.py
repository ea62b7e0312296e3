"""Fitted state on shared storage: champion model, scaler, medians and the training report.

Each save is a version in a folder of its own, ``versions/<name>``. Readers follow the pointer: the
last name in ``current``, an empty file that is created in one step when all else is written. So a
save that is killed halfway leaves the version before it in place, and readers that hold one go on
with it. A folder without a pointer is read as one version, as earlier releases wrote it.
"""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.boosting import BoostedTrees
from riskloom.operators.scaling import Scaler
from riskloom.schema import FEATURES, REPORT
from riskloom.storage import drop_paths, small_frame


@dataclass
class Artifacts:
    model: PipelineModel | BoostedTrees
    scaler: Scaler
    medians: dict[str, float]
    version: str | None = None


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names; None if there is none. Lists one small folder, no job."""
    names = _names(spark, f"{path}/current")
    return names[-1] if names else None


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Point to a version, in one step. Of two savers at once the larger name wins for all readers."""
    files, place = _folder(spark, f"{path}/current/{version}")
    if not files.createNewFile(place):
        raise FileExistsError(f"Version {version} was published before.")


def base_of(spark: SparkSession, path: str, version: str | None = None) -> str:
    """The folder that holds a version, by default the one that the pointer names."""
    version = version or current_version(spark, path)
    return f"{path}/versions/{version}" if version else path


def write_version(spark: SparkSession, path: str, artifacts: Artifacts, report: DataFrame | None = None) -> str:
    """Write everything under a new version name, which no reader follows yet."""
    # Unfinished saves keep their numbers, so the next one stands after them.
    found = [n for folder in ("current", "versions") for n in _names(spark, f"{path}/{folder}")]
    number = int(max(found).split("-")[0][1:]) + 1 if found else 1
    version = f"v{number:09d}-{uuid.uuid4().hex[:8]}"
    base = f"{path}/versions/{version}"
    artifacts.scaler.to_frame(spark).coalesce(1).write.parquet(f"{base}/scaler")
    medians = small_frame(spark, list(artifacts.medians.items()), "name string, median double")
    medians.coalesce(1).write.parquet(f"{base}/medians")
    if report is not None:
        write_report(report, base)
    if isinstance(artifacts.model, BoostedTrees):
        artifacts.model.save(f"{base}/model")
    else:
        artifacts.model.write().save(f"{base}/model")
    return version


def save_artifacts(
    spark: SparkSession, path: str, artifacts: Artifacts, report: DataFrame | None = None
) -> str:
    """Write a version and point to it; its name."""
    version = write_version(spark, path, artifacts, report)
    publish(spark, path, version)
    return version


def drop_versions(spark: SparkSession, path: str, keep: int = 5) -> None:
    """Delete all but the last versions, with what unfinished saves have left before them."""
    kept = _names(spark, f"{path}/current")[-keep:]
    if kept:
        for folder in ("current", "versions"):
            old = [n for n in _names(spark, f"{path}/{folder}") if n < kept[0]]
            drop_paths(spark, [f"{path}/{folder}/{n}" for n in old])


def load_artifacts(spark: SparkSession, path: str, version: str | None = None) -> Artifacts:
    version = version or current_version(spark, path)
    base = base_of(spark, path, version)
    try:
        scaler = Scaler.from_frame(spark.read.parquet(f"{base}/scaler"))
        medians = spark.read.parquet(f"{base}/medians").collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"No fitted scaler at {path}. Train a model first.") from e
    if not has_model(spark, path, version):
        raise FileNotFoundError(f"No model at {path}. Train a model first.")
    model = load_model(spark, f"{base}/model")
    return Artifacts(model, scaler, {r["name"]: r["median"] for r in medians}, version)


def load_model(spark: SparkSession, path: str) -> PipelineModel | BoostedTrees:
    kind = spark.read.schema("kind string").json(f"{path}/metadata").first()["kind"]
    return BoostedTrees.load(spark, path) if kind == BoostedTrees.__name__ else PipelineModel.load(path)


def has_model(spark: SparkSession, path: str, version: str | None = None) -> bool:
    try:
        return not spark.read.text(f"{base_of(spark, path, version)}/model/metadata").isEmpty()
    except AnalysisException:
        return False


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report as a one-row frame; no rows when there is none. Accepts a plain JSON file too."""
    try:
        return spark.read.schema(REPORT).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], REPORT)


def status(spark: SparkSession, path: str) -> DataFrame:
    """One row: is a model there, what is it called, how many features does it take."""
    loaded = has_model(spark, path)
    reports = read_report(spark, f"{path}/report")
    served = read_report(spark, f"{base_of(spark, path)}/report")
    reports = reports if served.isEmpty() else served
    found = reports.agg(F.first("best_model").alias("name"), F.first(F.size("feature_names")).alias("n"))
    return found.select(
        F.lit("ok").alias("status"),
        F.lit(loaded).alias("model_loaded"),
        F.when(F.lit(loaded), F.coalesce("name", F.lit("Unknown"))).alias("model_name"),
        F.coalesce("n", F.lit(len(FEATURES))).alias("n_features"),
    )
