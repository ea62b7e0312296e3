"""Every registered query: a name and a function of (session, data folder).

Each query reads whole tables. Queries over events score them with logistic models whose
coefficients are fixed here, so that any SQL engine can repeat the scores.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numeric import clip, whole
from riskloom.operators import perturb, reporting
from riskloom.operators.audit import load_audit, split_audit
from riskloom.operators.cleaning import (
    align,
    dedup,
    drop_label,
    drop_missing,
    quality_gates,
    validate,
)
from riskloom.operators.draws import feistel_shuffled, multinomial_draws
from riskloom.operators.evaluation import (
    binary_metrics,
    chance_line,
    champion,
    confusion,
    model_metrics,
    report,
    roc_auc,
    roc_points,
)
from riskloom.operators.ledger import DigestLedger
from riskloom.operators.medians import (
    batch_medians,
    fit_medians,
    impute,
    impute_from_batch,
    medians_in_two_scans,
)
from riskloom.operators.models import (
    MODEL_NAMES,
    FixedLogit,
    assembler,
    compare,
    fit_boosted,
    fit_forest,
    fit_logistic,
    importance,
    scorer_for,
)
from riskloom.operators.neighbours import nearest_neighbours
from riskloom.operators.ordering import places_of, shuffled, thin, time_sorted, with_row
from riskloom.operators.sampling import (
    bootstrap,
    of_class,
    stack,
    stratified_split,
    with_part,
)
from riskloom.operators.scaling import Scaler, apply_scaler, fit_scaler
from riskloom.operators.score_histogram import auc_bounds, merge_histograms, score_histogram
from riskloom.operators.sketches import column_sketches
from riskloom.operators.smote import smote, smote_count, synthesise
from riskloom.operators.weights import balanced_weights, class_counts, with_positive_weight
from riskloom.plans import training
from riskloom.plans.recipes import RECIPES, base_mix, scenario
from riskloom.plans.scoring import score_batch, score_rows
from riskloom.schema import EXPORT, FEATURES, KEY, LABEL, V_COLUMNS
from riskloom.sources import files
from riskloom.sources.artifacts import (
    load_artifacts,
    read_report,
    save_artifacts,
    status,
    write_report,
)
from riskloom.sources.tables import (
    table,
    tx_accounts,
    tx_embed,
    tx_events,
    tx_events_gaps,
    tx_events_raw,
    tx_lineitem,
    tx_orders,
)
from riskloom.storage import materialise, new_path, small_frame
from riskloom.streaming import live

SEED = 42
SMOTE_RATIO = 0.5

# Coefficients of the fixed scorers, first the one that single-model queries use.
LOGITS = {
    "mixed": (-1.0, {"Amount": 1.4, "Time": 0.5, "V1": 0.01}),
    "amount only": (0.2, {"Amount": 0.9}),
    "reversed": (0.0, {"Amount": -0.6, "Time": -0.3}),
}


def _logit(name: str = "mixed") -> FixedLogit:
    return FixedLogit(*LOGITS[name])


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(tx_events(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, name: str = "mixed") -> DataFrame:
    """All events scored by one fixed model."""
    events = _aligned_events(spark, sf_dir)
    return score_rows(events, _logit(name), fit_scaler(events))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row(_scored(spark, sf_dir).select(KEY, *EXPORT[1:]), KEY)


def _three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events scored by each fixed model, in long form."""
    events = _aligned_events(spark, sf_dir)
    scaled = apply_scaler(events, fit_scaler(events))
    return compare(scaled, {name: _logit(name) for name in LOGITS})


# -- scoring and reports ---------------------------------------------------------------------


def score_fixed_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(KEY, *EXPORT[1:])


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.summary(_scored(spark, sf_dir))


def kpi_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.kpis(batch_summary(spark, sf_dir))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.label_counts(_scored(spark, sf_dir))


def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.histogram(_scored(spark, sf_dir))


def top20_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select(KEY, *EXPORT[1:])
    return places_of(scored, reporting.top_risk(scored, by=KEY)).select("rank", *EXPORT)


def first500_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select(KEY, *EXPORT[1:])
    first = reporting.first_rows(scored, "fraud", by=KEY)
    return places_of(scored, first).select(*EXPORT, "matching", "shown")


def thin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select(KEY, "risk_score")
    return thin(scored).select("row", "risk_score")


def row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row(tx_events(spark, sf_dir).select(KEY), KEY)


def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.filter_label(_scored(spark, sf_dir), "legit").select(KEY, "label")


def display_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = reporting.with_badge(_scored(spark, sf_dir))
    return scored.select(KEY, "label", "confidence", "badge")


def batch_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scoring of a feed with gaps: batch medians fill them, predictions are numbered."""
    gaps = tx_events_gaps(spark, sf_dir)
    medians = batch_medians(align(gaps))
    scaler = fit_scaler(impute(align(gaps), medians))
    predictions, _ = score_batch(gaps, _logit(), scaler, medians)
    return predictions


# -- cleaning --------------------------------------------------------------------------------


def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(tx_lineitem(spark, sf_dir))


def dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_missing(tx_events_gaps(spark, sf_dir))


def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_from_batch(tx_events_gaps(spark, sf_dir), ["V1", "Amount"])


def column_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = fit_medians(tx_embed(spark, sf_dir), FEATURES)
    frame = small_frame(spark, list(medians.items()), "name string, median double")
    return _rounded(frame, "median")


def medians_two_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two batches are merged, then one scan finds the exact medians."""
    rows = tx_embed(spark, sf_dir)
    odd, even = (column_sketches(rows.where(f"{KEY} % 2 = {i}"), FEATURES) for i in (1, 0))
    both = {c: odd[c].merge(even[c]) for c in FEATURES}
    medians = medians_in_two_scans(rows, FEATURES, both)
    frame = small_frame(spark, list(medians.items()), "name string, median double")
    return _rounded(frame, "median")


def dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines arrive in three batches; a ledger of digests keeps each content once."""
    lines = materialise(tx_lineitem(spark, sf_dir).withColumn("part", F.monotonically_increasing_id() % 3), "lines")
    ledger = DigestLedger(spark, new_path(spark, "ledger"))
    for i in range(3):
        ledger.add(lines.where(f"part = {i}").drop("part"))
    return ledger.rows(lines.drop("part").schema)


def align_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned_events(spark, sf_dir)


def amount_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = validate(tx_accounts(spark, sf_dir))
    passed = valid.withColumn("reject_reason", F.lit(None).cast("string"))
    return stack(passed, rejected).select(KEY, "Amount", "reject_reason")


def clip_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("Amount")
    return tx_accounts(spark, sf_dir).select(
        KEY,
        F.round(clip(amount, 0.01, 5000.0), 2).alias("clipped"),
        whole(amount).cast("long").alias("truncated"),
    )


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gates(tx_events_raw(spark, sf_dir))


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaler = fit_scaler(tx_orders(spark, sf_dir))
    return _rounded(scaler.to_frame(spark), "mean", "std", digits=4)


def scaler_apply_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = with_part(tx_orders(spark, sf_dir), seed=SEED)
    scaled = apply_scaler(parts, fit_scaler(parts.filter(F.col("part") == "train")))
    return _rounded(scaled, "Time", "Amount").select(KEY, "part", "Time", "Amount")


def load_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_audit(tx_lineitem(spark, sf_dir))


def load_audit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_audit(tx_events_gaps(spark, sf_dir))


# -- splitting, sampling, rebalancing --------------------------------------------------------


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_part(tx_events(spark, sf_dir), seed=SEED).select(KEY, LABEL, "part")


def split_audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_audit(with_part(tx_events(spark, sf_dir), seed=SEED))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(balanced_weights(tx_events(spark, sf_dir)), "weight")


def pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positive_weight(tx_events(spark, sf_dir)).select(KEY, LABEL, "weight")


def class_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_class(tx_events(spark, sf_dir), 1)


def union_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tx_events(spark, sf_dir)
    return stack(of_class(events, 0), of_class(events, 1))


def drop_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_label(tx_orders(spark, sf_dir))


def bootstrap_fixed_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are rows."""
    events = tx_events(spark, sf_dir).select(KEY, "Amount")
    return bootstrap(events, events.count(), SEED)


def class_mix_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = base_mix(tx_events(spark, sf_dir), RECIPES["online_merchant"], SEED)
    return mixed.select("row", "mix_id", KEY, "Time", "V1", "Amount")


def class_mix_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = base_mix(tx_events(spark, sf_dir), RECIPES["travel_card"], SEED)
    return mixed.select("row", "mix_id", KEY, "Time", "V1", "Amount")


def scenario_with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = scenario(tx_embed(spark, sf_dir), "cash_withdrawals", SEED)
    return _rounded(mixed, *FEATURES).select("row", "mix_id", KEY, *FEATURES)


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_sorted(tx_orders(spark, sf_dir).select(KEY, "Time"))


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(tx_events(spark, sf_dir).select(KEY), SEED)


def feistel_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in their order, with their places in a keyed permutation."""
    numbered = materialise(with_row(tx_events(spark, sf_dir).select(KEY)), "numbered")
    return feistel_shuffled(numbered, numbered.count(), "row", SEED)


def draws_by_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are events, without ordering them."""
    events = materialise(tx_events(spark, sf_dir).select(KEY, "Amount"), "events")
    return multinomial_draws(events, events.count(), SEED, written=True)


def _scaled_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx_embed(spark, sf_dir)
    return apply_scaler(rows, fit_scaler(rows))


def smote_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    minority = _scaled_embed(spark, sf_dir).filter(F.col(LABEL) == 1)
    vectors = minority.select(KEY, F.array(*FEATURES).alias("features"))
    return _rounded(nearest_neighbours(vectors), "distance")


def all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among all rows, in blocks small enough that pivots and cells are in use."""
    vectors = _scaled_embed(spark, sf_dir).select(KEY, F.array(*FEATURES).alias("features"))
    return _rounded(nearest_neighbours(vectors, block_rows=128), "distance")


def smote_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled_embed(spark, sf_dir)
    counts = class_counts(rows)
    n_new = smote_count(counts[0], counts[1], SMOTE_RATIO)
    new = synthesise(rows.filter(F.col(LABEL) == 1), n_new, counts[1], seed=SEED)
    return _rounded(new, "step", *FEATURES)


def smote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = stratified_split(_scaled_embed(spark, sf_dir), seed=SEED)
    balanced = smote(train, SMOTE_RATIO, seed=SEED)
    return balanced.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


# -- evaluation ------------------------------------------------------------------------------


def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_three_models(spark, sf_dir))


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = binary_metrics(_three_models(spark, sf_dir))
    return _rounded(metrics, "accuracy", "precision", "recall", "f1")


def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roc_auc(_three_models(spark, sf_dir)), "roc_auc")


def auc_from_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of three batches of scores are merged; the bound holds for all rows."""
    scored = materialise(_three_models(spark, sf_dir), "three_models")
    parts = [score_histogram(scored.where(f"{KEY} % 3 = {i}")) for i in range(3)]
    return _rounded(auc_bounds(merge_histograms(*parts)), "auc", "error", "low", "high")


def roc_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = roc_points(_three_models(spark, sf_dir))
    return _rounded(stack(chance_line(points), points), "threshold", "fpr", "tpr")


def champion_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return champion(model_metrics(_three_models(spark, sf_dir)), list(LOGITS))


def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the fixed models, written as JSON, read back and flattened."""
    metrics = materialise(model_metrics(_three_models(spark, sf_dir)), "metrics")
    path = new_path(spark, "report")
    write_report(report(metrics, list(LOGITS), FEATURES), path)
    back = read_report(spark, f"{path}/report")
    return back.select("best_model", "best_roc_auc", F.inline("all_metrics"))


# -- models ----------------------------------------------------------------------------------


def _prepared(spark: SparkSession, sf_dir: str) -> training.Prepared:
    return training.prepare(tx_embed(spark, sf_dir), ratio=SMOTE_RATIO, seed=SEED)


def _one_model(spark: SparkSession, sf_dir: str, name: str, fit) -> DataFrame:
    return training.fit_all(_prepared(spark, sf_dir), {name: fit}).metrics


def train_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_model(spark, sf_dir, MODEL_NAMES[0], fit_logistic)


def train_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_model(spark, sf_dir, MODEL_NAMES[1], fit_forest)


def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_model(spark, sf_dir, MODEL_NAMES[2], fit_boosted)


def feature_importance_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = assembler().transform(_prepared(spark, sf_dir).train).select(LABEL, "features")
    return _rounded(importance(fit_forest(vectors)), "importance")


def train_and_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train all three, save the champion, and show what the artifact folder then holds."""
    out = new_path(spark, "artifacts")
    training.train(tx_embed(spark, sf_dir), out, ratio=SMOTE_RATIO, seed=SEED)
    held = status(spark, out)
    return read_report(spark, f"{out}/report").select(
        *[held.select(c).scalar().alias(c) for c in held.columns], F.inline("all_metrics")
    )


def batch_scored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, save, load, then score every row through the loaded artifacts."""
    prepared = _prepared(spark, sf_dir)
    trained = training.fit_all(prepared, {MODEL_NAMES[0]: fit_logistic})
    out = new_path(spark, "artifacts")
    save_artifacts(spark, out, trained.artifacts)
    loaded = load_artifacts(spark, out)
    scorer = scorer_for(loaded.model)
    predictions, _ = score_batch(tx_embed(spark, sf_dir), scorer, loaded.scaler, loaded.medians)
    return predictions


# -- perturbation ----------------------------------------------------------------------------


def perturb_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = perturb.gaussian_noise(tx_embed(spark, sf_dir), 0.15, SEED)
    return _rounded(noisy, *V_COLUMNS).select(KEY, *V_COLUMNS)


def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = perturb.sign_flip(tx_embed(spark, sf_dir), 0.08, SEED)
    return _rounded(flipped, *perturb.FLIPPED).select(KEY, *perturb.FLIPPED)


def amount_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.amount_jitter(tx_events(spark, sf_dir), 0.10, SEED).select(KEY, "Amount")


def time_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.time_drift(tx_events(spark, sf_dir), 300, SEED).select(KEY, "Time")


def cross_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = perturb.cross_noise(tx_embed(spark, sf_dir), SEED)
    return _rounded(noisy, *perturb.COUPLED).select(KEY, *perturb.COUPLED)


def plain_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = perturb.plain_noise(tx_embed(spark, sf_dir), 0.02, SEED)
    return _rounded(noisy, *FEATURES).select(KEY, *FEATURES)


# -- files and streams -----------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export all predictions to two folders, read the second one back."""
    paths = [new_path(spark, "export") for _ in range(2)]
    files.write_scored(_numbered(spark, sf_dir), *paths)
    return files.read_scored(spark, paths[1])


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the messy feed as CSV, read it back as good and quarantined rows."""
    path = new_path(spark, "feed")
    files.write_csv(tx_events_raw(spark, sf_dir), path)
    good, bad = files.read_transactions(spark, path)
    set_aside = bad.select(
        F.split("record", ",")[0].cast("long").alias(KEY),
        F.lit(None).cast("double").alias("Amount"),
        F.col("reason"),
    )
    return good.select(KEY, "Amount", F.lit(None).cast("string").alias("reason")).unionByName(set_aside)


def json_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as one JSON object per row, parsed back; overdrawn ones are rejected."""
    accounts = tx_accounts(spark, sf_dir)
    lines = accounts.select(F.to_json(F.struct(*accounts.columns)).alias("value"))
    valid, rejected = files.parse_json_transactions(lines)
    passed = valid.withColumn("reject_reason", F.lit(None).cast("string"))
    return stack(passed, rejected.drop("record")).select(KEY, "Time", "V1", "V2", "Amount", "reject_reason")


def _live_json(spark: SparkSession, folder: str, out: str, scaler: Scaler) -> DataFrame:
    """Score or reject all JSON lines of a folder in one query; its table, which holds both."""
    arriving = files.judge_json(files.stream_json(spark, folder))
    rows = live.score_and_reject(arriving, _logit(), scaler, {})
    live.to_parquet(rows, out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _live_totals(spark: SparkSession, folder: str, out: str, scaler: Scaler) -> DataFrame:
    """Score or reject all rows of a folder in one query, and keep totals over the stream of its table."""
    rows = live.score_and_reject(files.stream_transactions(spark, folder), _logit(), scaler, {})
    live.to_parquet(rows, out).awaitTermination()
    view = f"totals_{uuid.uuid4().hex}"
    scored = live.scored_rows(spark.readStream.schema(rows.schema).parquet(out))
    live.totals_to_view(live.running_totals(scored), view).awaitTermination()
    return spark.table(view)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events arrive as JSON lines and are scored on the way."""
    events = _aligned_events(spark, sf_dir)
    folder, out = new_path(spark, "incoming"), new_path(spark, "live-scores")
    fields = F.struct(*[c for c in events.columns if c != LABEL])
    events.select(F.to_json(fields).alias("value")).write.text(folder)
    return live.scored_rows(_live_json(spark, folder, out, fit_scaler(events)))


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events arrive as parquet files; the totals are kept while they are scored."""
    events = _aligned_events(spark, sf_dir)
    folder, out = new_path(spark, "incoming"), new_path(spark, "live-totals")
    events.drop(LABEL).write.parquet(folder)
    return _live_totals(spark, folder, out, fit_scaler(events))


def hourly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, scored, as a stream of event time: totals per hour."""
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), F.col("ts").cast("timestamp").alias("at"))
    folder, out = new_path(spark, "timed"), new_path(spark, "hourly")
    _scored(spark, sf_dir).select(KEY, "label").join(times, KEY).write.parquet(folder)
    stream = spark.readStream.schema(f"{KEY} long, label string, at timestamp").parquet(folder)
    live.totals_and_late(stream, KEY, "at", "1 hour", "10 minutes", out).awaitTermination()
    totals = live.read_totals(spark, out)
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return totals.select(start.alias("hour"), "total_rows", "fraud_count", "legit_count", "fraud_rate")


QUERIES = {
    "score_fixed_logit": score_fixed_logit,
    "batch_summary": batch_summary,
    "kpi_display": kpi_display,
    "label_counts": label_counts,
    "risk_histogram": risk_histogram,
    "top20_risk": top20_risk,
    "first500_fraud": first500_fraud,
    "thin_series": thin_series,
    "row_ordinal": row_ordinal,
    "label_filter": label_filter,
    "display_badge": display_badge,
    "batch_with_gaps": batch_with_gaps,
    "dedup": dedup_rows,
    "dropna": dropna,
    "median_impute": median_impute,
    "column_medians": column_medians,
    "medians_two_scans": medians_two_scans,
    "dedup_batches": dedup_batches,
    "align_defaults": align_defaults,
    "amount_quarantine": amount_quarantine,
    "clip_round": clip_round,
    "quality_gates": quality_checks,
    "scaler_fit": scaler_fit,
    "scaler_apply_train_only": scaler_apply_train_only,
    "load_audit": load_audit_lines,
    "load_audit_gaps": load_audit_gaps,
    "stratified_split": stratified,
    "split_audit": split_audit_events,
    "class_weights": class_weights,
    "pos_weight": pos_weight,
    "class_partition": class_partition,
    "union_classes": union_classes,
    "drop_target": drop_target,
    "bootstrap_fixed_n": bootstrap_fixed_n,
    "class_mix": class_mix_shuffled,
    "class_mix_by_time": class_mix_by_time,
    "scenario_with_noise": scenario_with_noise,
    "time_sorted": time_order,
    "seeded_shuffle": seeded_shuffle,
    "feistel_shuffle": feistel_shuffle,
    "draws_by_splitting": draws_by_splitting,
    "smote_neighbours": smote_neighbours,
    "all_neighbours": all_neighbours,
    "smote_synthetic": smote_synthetic,
    "smote_counts": smote_counts,
    "confusion": confusion_cells,
    "binary_metrics": threshold_metrics,
    "roc_auc": roc_auc_exact,
    "auc_from_histograms": auc_from_histograms,
    "roc_points": roc_curve_points,
    "champion_select": champion_select,
    "metrics_report": metrics_report,
    "train_lr": train_lr,
    "train_rf": train_rf,
    "train_gbt": train_gbt,
    "feature_importance_top15": feature_importance_top15,
    "train_and_save": train_and_save,
    "batch_scored_model": batch_scored_model,
    "perturb_gaussian": perturb_gaussian,
    "sign_flip": sign_flip,
    "amount_jitter": amount_jitter,
    "time_drift": time_drift,
    "cross_noise": cross_noise,
    "plain_noise": plain_noise,
    "csv_roundtrip": csv_roundtrip,
    "csv_quarantine": csv_quarantine,
    "json_transactions": json_transactions,
    "stream_scores": stream_scores,
    "stream_totals": stream_totals,
    "hourly_totals": hourly_totals,
}
