"""Risk bands, badges and the two rounded score columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.numeric import known
from riskloom.schema import BANDS, LOWEST_BAND


def _banded(p: Column, values: list[tuple[float, str]], lowest: str) -> Column:
    """First band whose lower cut is reached; an unknown probability has no band."""
    p = known(p)
    out = F.when(p < min(cut for cut, _ in values), lowest)
    for cut, value in values:
        out = out.when(p >= cut, value)
    return out


def label_of(p: Column, bands=BANDS, lowest=LOWEST_BAND) -> Column:
    return _banded(p, [(cut, label) for cut, label, _ in bands], lowest[0])


def confidence_of(p: Column, bands=BANDS, lowest=LOWEST_BAND) -> Column:
    return _banded(p, [(cut, confidence) for cut, _, confidence in bands], lowest[1])


def risk_score(p: Column) -> Column:
    return F.round(p * 100.0, 2)


def fraud_probability(p: Column) -> Column:
    return F.round(p, 4)


def badge(label: Column, confidence: Column) -> Column:
    """Display tier of a scored row."""
    return (
        F.when((label == "FRAUD") & (confidence == "HIGH"), "fraud")
        .when(label == "FRAUD", "medium")
        .otherwise("safe")
    )


def hard_class(p: Column) -> Column:
    """Predicted class; a probability of exactly one half goes to class 0."""
    return (p > 0.5).cast("int")


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def slug(name: Column) -> Column:
    """Model name as a file name part."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))
