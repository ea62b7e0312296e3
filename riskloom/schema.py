"""Column names, schemas and fixed values shared by every module."""

from pyspark.sql import types as T

KEY = "tx_id"
LABEL = "Class"

# Feature order of a transaction.
V_COLUMNS = [f"V{i}" for i in range(1, 29)]
FEATURES = ["Time", *V_COLUMNS, "Amount"]

# The only columns that are standardised, and the columns training needs.
SCALED = ["Amount", "Time"]
REQUIRED = ["Time", "Amount", "Class"]

# Lower-inclusive risk bands on the unrounded probability, highest first.
BANDS = [
    (0.80, "FRAUD", "HIGH"),
    (0.50, "FRAUD", "MEDIUM"),
    (0.30, "LEGIT", "LOW RISK"),
]
LOWEST_BAND = ("LEGIT", "SAFE")

# Histogram bins over risk_score, half-open; the last one includes 100.
RISK_BINS = [(0, 10), (10, 20), (20, 30), (30, 50), (50, 70), (70, 90), (90, 101)]

# Column order of an exported prediction file.
EXPORT = ["row", "amount", "risk_score", "fraud_probability", "label", "confidence"]

# Text that a CSV reader of the pandas family takes for a missing number.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

TX = T.StructType(
    [T.StructField(KEY, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in FEATURES]
)
LABELLED_TX = T.StructType([*TX.fields, T.StructField(LABEL, T.IntegerType())])

EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.StringType()),
    ]
)

METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc"]
METRICS = T.StructType(
    [T.StructField("model", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in METRIC_NAMES]
)
REPORT = T.StructType(
    [
        T.StructField("best_model", T.StringType()),
        T.StructField("best_roc_auc", T.DoubleType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("all_metrics", T.ArrayType(METRICS)),
    ]
)
