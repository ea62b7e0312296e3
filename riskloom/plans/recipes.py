"""Named scenario mixes: how many rows of each class, what is replaced, which noise is added."""

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import gaussian, integer_below, uniform_between
from riskloom.functions.numeric import clip
from riskloom.operators.perturb import inject_noise, plain_noise
from riskloom.operators.sampling import MixPart, class_mix

Override = tuple


@dataclass(frozen=True)
class Recipe:
    legit: int
    fraud: int
    order: str = "shuffled"
    legit_with: dict[str, Override] = field(default_factory=dict)
    fraud_with: dict[str, Override] = field(default_factory=dict)
    v_scale: float = 0.15
    amount_pct: float = 0.10
    drift: int = 300
    flip_prob: float = 0.08
    plain_scale: float = 0.015


_CASH = ("one_of", [20.0, 40.0, 50.0, 60.0, 80.0, 100.0, 200.0])
_LATE = {"Time": ("whole", 64_800, 86_400)}

# The scenario mixes. Upper ends of whole-number ranges are exclusive.
RECIPES = {
    "weekend_shopping": Recipe(
        50, 0, legit_with={"Time": ("whole", 43_200, 86_400)},
        v_scale=0.20, amount_pct=0.12, plain_scale=0.02,
    ),
    "stolen_card": Recipe(
        0, 30, fraud_with={"Time": ("whole", 10_800, 14_400)},
        v_scale=0.15, amount_pct=0.08, plain_scale=0.01,
    ),
    "corporate_card": Recipe(68, 12, v_scale=0.18, amount_pct=0.15, plain_scale=0.02),
    "online_merchant": Recipe(
        32, 8,
        legit_with={"Amount": ("uniform", 0.5, 15.0)}, fraud_with={"Amount": ("uniform", 0.5, 5.0)},
        v_scale=0.25, amount_pct=0.20, flip_prob=0.12, plain_scale=0.03,
    ),
    "retailer_day": Recipe(492, 8, order="time", v_scale=0.20, drift=600, plain_scale=0.02),
    "high_value": Recipe(
        80, 20,
        legit_with={"Amount": ("uniform", 500, 8_000)},
        fraud_with={"Amount": ("uniform", 2_000, 15_000)},
        v_scale=0.22, amount_pct=0.12,
    ),
    "card_testing": Recipe(
        140, 60, order="time",
        legit_with={"Time": ("whole", 0, 600)},
        fraud_with={"Time": ("whole", 0, 600), "Amount": ("uniform", 0.5, 3.0)},
        v_scale=0.15, amount_pct=0.08, drift=30, plain_scale=0.01,
    ),
    "returns_abuse": Recipe(
        135, 15,
        legit_with={"Amount": ("uniform", 20, 300)}, fraud_with={"Amount": ("uniform", 150, 500)},
        v_scale=0.20, amount_pct=0.15, flip_prob=0.10,
    ),
    "travel_card": Recipe(
        190, 10, order="time",
        legit_with=_LATE, fraud_with={**_LATE, "Amount": ("lognormal", 5.5, 0.8, 100, 10_000)},
        v_scale=0.18, drift=600,
    ),
    "cash_withdrawals": Recipe(
        50, 50, legit_with={"Amount": _CASH}, fraud_with={"Amount": _CASH},
        v_scale=0.25, amount_pct=0.05, flip_prob=0.15, plain_scale=0.02,
    ),
    "known_fraud": Recipe(3, 7, v_scale=0.12, amount_pct=0.05),
}


# The mixes with plain noise: the first one leaves Time as it was drawn, the last one has no such form.
PLAIN_RECIPES = {
    **{name: recipe for name, recipe in RECIPES.items() if name != "known_fraud"},
    "weekend_shopping": replace(RECIPES["weekend_shopping"], legit_with={}),
}


def _drawn(spec: Override, seed: int, tag: str) -> Column:
    """One replacement value per draw number."""
    kind, args, key = spec[0], spec[1:], F.col("draw")
    if kind == "whole":
        low, high = args
        return (integer_below(high - low, seed, tag, key) + low).cast("double")
    if kind == "uniform":
        return F.round(uniform_between(*args, seed, tag, key), 2)
    if kind == "lognormal":
        mu, sigma, low, high = args
        value = F.exp(F.lit(mu) + F.lit(sigma) * gaussian(seed, tag, key))
        return F.round(clip(value, low, high), 2)
    values = F.array(*[F.lit(v) for v in args[0]])
    return F.get(values, integer_below(len(args[0]), seed, tag, key).cast("int"))


def _part(n: int, overrides: dict[str, Override], seed: int, name: str) -> MixPart:
    return MixPart(n, {c: _drawn(spec, seed, f"{name}-{c}") for c, spec in overrides.items()})


def base_mix(df: DataFrame, recipe: Recipe, seed: int = 42) -> DataFrame:
    """The drawn rows with replaced columns, before any noise."""
    legit = _part(recipe.legit, recipe.legit_with, seed, "legit")
    fraud = _part(recipe.fraud, recipe.fraud_with, seed, "fraud")
    return class_mix(df, legit, fraud, recipe.order, seed)


def scenario(df: DataFrame, name: str, seed: int = 42, plain: bool = False) -> DataFrame:
    """A named mix from labelled rows, with full noise or with plain additive noise only."""
    recipe = (PLAIN_RECIPES if plain else RECIPES)[name]
    mixed = base_mix(df, recipe, seed)
    if plain:
        return plain_noise(mixed, recipe.plain_scale, seed, "mix_id")
    return inject_noise(
        mixed, recipe.v_scale, recipe.amount_pct, recipe.drift, recipe.flip_prob, seed, "mix_id"
    )
