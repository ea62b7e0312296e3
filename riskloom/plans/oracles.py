"""SQL that gives the result of each registered query, for an engine with the same tables.

Written from the definition of each operator, not from the way the Spark code computes it: plain
rankings instead of block offsets, sorts instead of selection, all pairs instead of pivots.
"""

from riskloom.plans.recipes import RECIPES
from riskloom.plans.registry import LOGITS, SEED, SMOTE_RATIO
from riskloom.schema import BANDS, FEATURES, LOWEST_BAND, RISK_BINS, V_COLUMNS

_WORD = "4503599627370496::DOUBLE"


# -- building blocks -------------------------------------------------------------------------


def _digest(tag: str, key: str) -> str:
    return f"md5(concat('{SEED}|{tag}|', {key}))"


def _word(digest: str, start: int) -> str:
    return f"(('0x' || substr({digest}, {start}, 13))::BIGINT)"


def _uniform(tag: str, key: str) -> str:
    return f"({_word(_digest(tag, key), 1)} / {_WORD})"


def _gaussian(tag: str, key: str) -> str:
    d = _digest(tag, key)
    return (
        f"(sqrt(-2 * ln(({_word(d, 1)} + 1) / {_WORD}))"
        f" * cos(2 * pi() * ({_word(d, 14)} / {_WORD})))"
    )


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _columns(names, form="{c}") -> str:
    return ", ".join(form.format(c=c) for c in names)


def _rounded(names) -> str:
    return _columns(names, "round({c}, 6) AS {c}")


_SINCE = "((epoch_us({c}) - (SELECT min(epoch_us({c})) FROM {t})) / 1000000::DOUBLE)"

EVENTS = f"""tx AS (
  SELECT event_id AS tx_id, {_SINCE.format(c="ts", t="events")} AS "Time",
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS V1, value AS Amount,
         CAST(event_type = 'error' AS INTEGER) AS Class
  FROM events)"""

GAPS = f"""tx AS (
  SELECT event_id AS tx_id, {_SINCE.format(c="ts", t="events")} AS "Time",
         CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS V1,
         CASE WHEN event_type <> 'signup' THEN value END AS Amount,
         CAST(event_type = 'error' AS INTEGER) AS Class
  FROM events)"""

ORDERS = f"""tx AS (
  SELECT o_orderkey AS tx_id, {_SINCE.format(c="o_orderdate", t="orders")} AS "Time",
         o_totalprice AS Amount, CAST(o_orderstatus = 'F' AS INTEGER) AS Class
  FROM orders)"""

LINES = f"""tx AS (
  SELECT {_SINCE.format(c="l_shipdate", t="lineitem")} AS "Time", l_discount AS V1, l_tax AS V2,
         l_quantity AS Amount, CAST(l_returnflag = 'R' AS INTEGER) AS Class
  FROM lineitem)"""

EMBED = f"""tx AS (
  SELECT vec_id AS tx_id, vec_id::DOUBLE AS "Time",
         {", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(V_COLUMNS))},
         list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS Amount,
         CAST(label = 0 AS INTEGER) AS Class
  FROM embeddings)"""

_SCALE = "({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END)"


def _band(p: str, at: int) -> str:
    cases = " ".join(f"WHEN {p} >= {band[0]} THEN '{band[at]}'" for band in BANDS)
    return f"CASE {cases} ELSE '{LOWEST_BAND[at - 1]}' END"


def _z(name: str) -> str:
    """Terms in the order in which the Spark expression adds them."""
    intercept, weights = LOGITS[name]
    scaled = {"Amount": "s_amount", "Time": "s_time", "V1": "V1"}
    return f"{intercept}::DOUBLE" + "".join(f" + ({w}::DOUBLE) * {scaled[c]}" for c, w in weights.items())


def _scored(tx: str, name: str = "mixed", source: str = "tx") -> str:
    return _with(
        tx,
        f"""scaled AS (SELECT *, {_SCALE.format(c="Amount")} AS s_amount,
            {_SCALE.format(c='"Time"')} AS s_time FROM {source})""",
        f"probs AS (SELECT *, 1 / (1 + exp(-({_z(name)}))) AS p FROM scaled)",
        f"""scored AS (SELECT tx_id, Class, round(Amount, 2) AS amount, p, round(p, 4) AS fraud_probability,
            round(p * 100, 2) AS risk_score, {_band("p", 1)} AS label, {_band("p", 2)} AS confidence
            FROM probs)""",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY tx_id) AS row FROM scored)",
    )


_THREE = _with(
    EVENTS,
    f"""scaled AS (SELECT *, {_SCALE.format(c="Amount")} AS s_amount,
        {_SCALE.format(c='"Time"')} AS s_time FROM tx)""",
    "probs AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS model, tx_id, Class, 1 / (1 + exp(-({_z(name)}))) AS p FROM scaled"
        for name in LOGITS
    )
    + ")",
    "judged AS (SELECT *, CAST(p > 0.5 AS INTEGER) AS prediction FROM probs)",
    """cells AS (SELECT model,
        count(*) FILTER (Class = 1 AND prediction = 1) AS tp,
        count(*) FILTER (Class = 0 AND prediction = 1) AS fp,
        count(*) FILTER (Class = 1 AND prediction = 0) AS fn,
        count(*) FILTER (Class = 0 AND prediction = 0) AS tn
        FROM judged GROUP BY model)""",
    """steps AS (SELECT model, p, count(*) FILTER (Class = 1) AS pos, count(*) FILTER (Class = 0) AS neg
        FROM judged GROUP BY model, p)""",
    """cum AS (SELECT *, sum(pos) OVER d AS tps, sum(neg) OVER d AS fps,
        sum(pos) OVER (PARTITION BY model) AS all_pos, sum(neg) OVER (PARTITION BY model) AS all_neg,
        row_number() OVER d AS place, lead(pos) OVER d AS pos_next, lead(neg) OVER d AS neg_next
        FROM steps WINDOW d AS (PARTITION BY model ORDER BY p DESC))""",
    """aucs AS (SELECT model, sum(pos * ((all_neg - fps) + neg / 2)) / (max(all_pos)::DOUBLE * max(all_neg)) AS roc_auc
        FROM cum GROUP BY model)""",
    """metrics AS (SELECT model, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
        round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,
        round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
        round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
        round(roc_auc, 4) AS roc_auc
        FROM cells JOIN aucs USING (model))""",
    "listed AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', {i})" for i, name in enumerate(LOGITS))
    + ") AS v(model, place))",
    "best AS (SELECT metrics.* FROM metrics JOIN listed USING (model) ORDER BY roc_auc DESC, place LIMIT 1)",
)


def _split(tx: str) -> str:
    """Training share per class by largest remainder, the smallest digests of a class are its test rows."""
    return _with(
        tx,
        "classes AS (SELECT Class, count(*) AS n FROM tx GROUP BY Class)",
        "shares AS (SELECT Class, n, (sum(n) OVER () - ceil(sum(n) OVER () * 0.2)) AS n_train FROM classes)",
        """floors AS (SELECT *, floor(n_train * n / sum(n) OVER ()) AS low,
            n_train * n / sum(n) OVER () - floor(n_train * n / sum(n) OVER ()) AS rest FROM shares)""",
        """sizes AS (SELECT Class, n - low - CASE WHEN row_number() OVER (ORDER BY rest DESC, Class)
            <= n_train - sum(low) OVER () THEN 1 ELSE 0 END AS n_test FROM floors)""",
        f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY {_digest("split", "tx_id")}) AS place
            FROM tx)""",
        """split AS (SELECT ranked.* EXCLUDE (place),
            CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS part
            FROM ranked JOIN sizes USING (Class))""",
    )


def _drawn(spec: tuple, tag: str) -> str:
    kind, args = spec[0], spec[1:]
    if kind == "whole":
        return f"(floor({_uniform(tag, 'draw')} * {args[1] - args[0]}) + {args[0]})::DOUBLE"
    if kind == "uniform":
        return f"round({float(args[0])}::DOUBLE + {_uniform(tag, 'draw')} * {float(args[1] - args[0])}::DOUBLE, 2)"
    if kind == "lognormal":
        mu, sigma, low, high = args
        value = f"exp({mu}::DOUBLE + {sigma}::DOUBLE * {_gaussian(tag, 'draw')})"
        return f"round(least(greatest({value}, {low}), {high}), 2)"
    values = args[0]
    return f"(list_value({', '.join(map(str, values))})[1 + floor({_uniform(tag, 'draw')} * {len(values)})::INTEGER])::DOUBLE"


def _mix(tx: str, name: str, columns: list[str]) -> str:
    recipe = RECIPES[name]
    parts = []
    for kind, value, n, start, overrides in (
        ("legit", 0, recipe.legit, 0, recipe.legit_with),
        ("fraud", 1, recipe.fraud, recipe.legit, recipe.fraud_with),
    ):
        if not n:
            continue
        replaced = [
            f"{_drawn(overrides[c], f'{kind}-{c}')} AS {c}" if c in overrides else c for c in columns
        ]
        parts.append(
            f"""SELECT tx_id, draw + {start} AS mix_id, {", ".join(replaced)}
            FROM (SELECT range AS draw, floor({_uniform(f"pick-{kind}", "range")}
                  * (SELECT count(*) FROM tx WHERE Class = {value})) + 1 AS place FROM range({n}))
            JOIN (SELECT *, row_number() OVER (ORDER BY tx_id) AS place FROM tx WHERE Class = {value})
            USING (place)"""
        )
    order = '"Time", mix_id' if recipe.order == "time" else f"{_digest('shuffle', 'mix_id')}, mix_id"
    return _with(
        tx,
        "drawn AS (" + " UNION ALL ".join(parts) + ")",
        f"mix AS (SELECT *, row_number() OVER (ORDER BY {order}) AS row FROM drawn)",
    )


def _noise_steps(source: str, key: str, recipe) -> list[str]:
    """The five perturbations, each as one step over the last."""
    from riskloom.operators.perturb import COUPLED, FLIPPED

    sd = "CASE WHEN coalesce(stddev_samp({c}) OVER (), 0) = 0 THEN 1 ELSE stddev_samp({c}) OVER () END"
    noise = ", ".join(
        f"{c} + {recipe.v_scale} * ({sd.format(c=c)}) * {_gaussian(f'noise-{c}', key)} AS {c}"
        for c in V_COLUMNS
    )
    flips = ", ".join(
        f"CASE WHEN {_uniform(f'flip-{c}', key)} < {recipe.flip_prob} THEN -{c} ELSE {c} END AS {c}"
        for c in FLIPPED
    )
    coupled = ", ".join(
        f"{c} + 0.05 * {_gaussian('cross', key)} * (0.5 + 0.3 * {_gaussian_constant(f'factor-{c}')}) AS {c}"
        for c in COUPLED
    )
    return [
        f"noisy AS (SELECT * REPLACE ({noise}) FROM {source})",
        f"flipped AS (SELECT * REPLACE ({flips}) FROM noisy)",
        f"""jittered AS (SELECT * REPLACE (round(greatest(Amount * (1 + (-{recipe.amount_pct}
            + {_uniform("amount", key)} * {2 * recipe.amount_pct})), 0.01), 2) AS Amount) FROM flipped)""",
        f"""drifted AS (SELECT * REPLACE (trunc(greatest("Time" + floor({_uniform("drift", key)}
            * {2 * recipe.drift + 1}) - {recipe.drift}, 0)) AS "Time") FROM jittered)""",
        f"crossed AS (SELECT * REPLACE ({coupled}) FROM drifted)",
    ]


def _gaussian_constant(tag: str) -> str:
    return _gaussian(tag, "'constant'")


def _aligned_columns(*present: str) -> str:
    return ", ".join(c if c in present else f"0.0::DOUBLE AS {c}" for c in FEATURES)


_SCALED_EMBED = (
    EMBED
    + f""",
scaled AS (SELECT * REPLACE ({_SCALE.format(c="Amount")} AS Amount, {_SCALE.format(c='"Time"')} AS "Time") FROM tx),
vectors AS (SELECT tx_id, Class, [{", ".join(FEATURES)}] AS v FROM scaled)"""
)

_DISTANCE = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _neighbours(where: str) -> str:
    return f"""near AS (
  SELECT id, nn_rank, nn_id, sqrt(d2) AS distance FROM (
    SELECT a.tx_id AS id, b.tx_id AS nn_id, {_DISTANCE} AS d2,
           row_number() OVER (PARTITION BY a.tx_id ORDER BY {_DISTANCE}, b.tx_id) AS nn_rank
    FROM (SELECT * FROM vectors {where}) a JOIN (SELECT * FROM vectors {where}) b ON a.tx_id <> b.tx_id)
  WHERE nn_rank <= 5)"""


_PREDICTION = "amount, risk_score, fraud_probability, label, confidence"

_RECIPE = RECIPES["cash_withdrawals"]


def _medians(columns) -> str:
    return ", ".join(f"median({c}) OVER () AS m_{c}" for c in columns)


_GAPS_FILLED = (
    GAPS
    + """,
filled AS (SELECT tx_id, "Time", Class, coalesce(V1, median(V1) OVER ()) AS V1,
           coalesce(Amount, median(Amount) OVER ()) AS Amount, Amount AS raw_amount FROM tx)"""
)

# -- one statement per query -----------------------------------------------------------------

ORACLES = {
    "score_fixed_logit": _scored(EVENTS) + f"SELECT tx_id, {_PREDICTION} FROM scored",
    "batch_summary": _scored(EVENTS)
    + """SELECT count(*) AS total_rows, count(*) FILTER (label = 'FRAUD') AS fraud_count,
    count(*) FILTER (label = 'LEGIT') AS legit_count,
    round(count(*) FILTER (label = 'FRAUD') / count(*) * 100, 4) AS fraud_rate FROM scored""",
    "kpi_display": _scored(EVENTS)
    + """SELECT format('{:,}', n) AS total, format('{:,}', f) AS fraud, format('{:,}', n - f) AS legit,
    printf('%.2f%%', round(f / n * 100, 4)) AS rate,
    concat('Showing ', format('{:,}', n), ' transactions · ', f, ' flagged') AS subtitle
    FROM (SELECT count(*) AS n, count(*) FILTER (label = 'FRAUD') AS f FROM scored)""",
    "label_counts": _scored(EVENTS)
    + """SELECT v.label, count(scored.label) AS n FROM (VALUES ('FRAUD'), ('LEGIT')) AS v(label)
    LEFT JOIN scored USING (label) GROUP BY v.label""",
    "risk_histogram": _scored(EVENTS)
    + "SELECT bin, low, high, count(tx_id) AS n FROM (VALUES "
    + ", ".join(f"('{low}-{min(high, 100)}%', {low}, {high})" for low, high in RISK_BINS)
    + """) AS bins(bin, low, high)
    LEFT JOIN scored ON risk_score >= low AND risk_score < high GROUP BY bin, low, high""",
    "top20_risk": _scored(EVENTS)
    + f"""SELECT row_number() OVER (ORDER BY risk_score DESC, row)::INTEGER AS rank, row, {_PREDICTION}
    FROM numbered ORDER BY risk_score DESC, row LIMIT 20""",
    "first500_fraud": _scored(EVENTS)
    + f"""SELECT row, {_PREDICTION}, count(*) OVER () AS matching, least(count(*) OVER (), 500) AS shown
    FROM numbered WHERE label = 'FRAUD' ORDER BY row LIMIT 500""",
    "thin_series": _scored(EVENTS)
    + """SELECT row, risk_score FROM numbered
    WHERE (row - 1) % greatest(1, (SELECT count(*) FROM scored) // 200) = 0""",
    "row_ordinal": "SELECT event_id AS tx_id, row_number() OVER (ORDER BY event_id) AS row FROM events",
    "label_filter": _scored(EVENTS) + "SELECT tx_id, label FROM scored WHERE label = 'LEGIT'",
    "display_badge": _scored(EVENTS)
    + """SELECT tx_id, label, confidence, CASE WHEN label = 'FRAUD' AND confidence = 'HIGH' THEN 'fraud'
    WHEN label = 'FRAUD' THEN 'medium' ELSE 'safe' END AS badge FROM scored""",
    "batch_with_gaps": _scored(_GAPS_FILLED, source="filled").replace(
        "round(Amount, 2) AS amount", "round(raw_amount, 2) AS amount"
    )
    + f"SELECT tx_id, row, {_PREDICTION} FROM numbered",
    "dedup": _with(LINES)
    + 'SELECT "Time", V1, V2, Amount, Class, count(*) AS copies FROM tx GROUP BY ALL',
    "dropna": _with(GAPS)
    + 'SELECT * FROM tx WHERE "Time" IS NOT NULL AND V1 IS NOT NULL AND Amount IS NOT NULL AND Class IS NOT NULL',
    "median_impute": _with(_GAPS_FILLED) + 'SELECT tx_id, "Time", V1, Amount, Class FROM filled',
    "column_medians": _with(EMBED)
    + " UNION ALL ".join(f"SELECT '{c}' AS name, round(median({c}), 6) AS median FROM tx" for c in FEATURES),
    "align_defaults": _with(EVENTS)
    + f"SELECT tx_id, Class, {_aligned_columns('Time', 'V1', 'Amount')} FROM tx",
    "amount_quarantine": """SELECT c_custkey AS tx_id, c_acctbal AS Amount,
    CASE WHEN c_acctbal < 0 THEN 'negative amount' END AS reject_reason FROM customer""",
    "clip_round": """SELECT c_custkey AS tx_id, round(least(greatest(c_acctbal, 0.01), 5000), 2) AS clipped,
    trunc(c_acctbal)::BIGINT AS truncated FROM customer""",
    "quality_gates": """SELECT n_rows, gate, n_failed, n_failed = 0 AS passed FROM
    (SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'view') AS bad FROM events),
    LATERAL (VALUES ('required_columns', 0), ('not_empty', CAST(n_rows = 0 AS BIGINT)), ('parsable', bad))
    AS g(gate, n_failed)""",
    "scaler_fit": _with(ORDERS)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS name, round(avg("{c}"), 4) AS mean, round(stddev_pop("{c}"), 4) AS std FROM tx"""
        for c in ("Amount", "Time")
    ),
    "scaler_apply_train_only": _split(ORDERS)
    + """SELECT tx_id, part, round(("Time" - tm) / ts, 6) AS "Time", round((Amount - am) / sd, 6) AS Amount
    FROM split, (SELECT avg("Time") AS tm, stddev_pop("Time") AS ts, avg(Amount) AS am, stddev_pop(Amount) AS sd
    FROM split WHERE part = 'train')""",
    "load_audit": _with(LINES, "kept AS (SELECT DISTINCT * FROM tx)")
    + """SELECT n_rows, 5 AS n_columns, fraud_pct, n_rows - (SELECT count(*) FROM kept) AS duplicates_dropped,
    0::BIGINT AS incomplete_dropped, (SELECT count(*) FROM kept) AS n_clean
    FROM (SELECT count(*) AS n_rows, round(avg(Class) * 100, 4) AS fraud_pct FROM tx)""",
    "load_audit_gaps": _with(GAPS, "kept AS (SELECT DISTINCT * EXCLUDE (tx_id) FROM tx)")
    + """SELECT n_rows, 4 AS n_columns, fraud_pct, n_rows - (SELECT count(*) FROM kept) AS duplicates_dropped,
    (SELECT count(*) FROM kept WHERE V1 IS NULL OR Amount IS NULL) AS incomplete_dropped,
    (SELECT count(*) FROM kept WHERE V1 IS NOT NULL AND Amount IS NOT NULL) AS n_clean
    FROM (SELECT count(*) AS n_rows, round(avg(Class) * 100, 4) AS fraud_pct FROM tx)""",
    "stratified_split": _split(EVENTS) + "SELECT tx_id, Class, part FROM split",
    "split_audit": _split(EVENTS)
    + "SELECT part, count(*) AS n_rows, round(avg(Class) * 100, 4) AS fraud_pct FROM split GROUP BY part",
    "class_weights": _with(EVENTS)
    + "SELECT Class, count(*) AS n, round((SELECT count(*) FROM tx) / (2 * count(*)), 6) AS weight FROM tx GROUP BY Class",
    "pos_weight": _with(EVENTS)
    + "SELECT tx_id, Class, CASE WHEN Class = 1 THEN 100::DOUBLE ELSE 1::DOUBLE END AS weight FROM tx",
    "class_partition": _with(EVENTS) + 'SELECT tx_id, "Time", V1, Amount FROM tx WHERE Class = 1',
    "union_classes": _with(EVENTS) + 'SELECT tx_id, "Time", V1, Amount FROM tx',
    "drop_target": _with(ORDERS) + 'SELECT tx_id, "Time", Amount FROM tx',
    "bootstrap_fixed_n": f"""SELECT event_id AS tx_id, value AS Amount, draw FROM
    (SELECT i AS draw, floor({_uniform("pick", "i")} * (SELECT count(*) FROM events)) + 1 AS place
     FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i))
    JOIN (SELECT *, row_number() OVER (ORDER BY event_id) AS place FROM events) USING (place)""",
    "class_mix": _mix(EVENTS, "online_merchant", ["Time", "V1", "Amount"])
    + 'SELECT row, mix_id, tx_id, "Time", V1, Amount FROM mix',
    "class_mix_by_time": _mix(EVENTS, "travel_card", ["Time", "V1", "Amount"])
    + 'SELECT row, mix_id, tx_id, "Time", V1, Amount FROM mix',
    "scenario_with_noise": _mix(EMBED, "cash_withdrawals", FEATURES).rstrip()
    + ",\n"
    + ",\n".join(_noise_steps("mix", "mix_id", _RECIPE))
    + f"\nSELECT row, mix_id, tx_id, {_rounded(FEATURES)} FROM crossed",
    "time_sorted": _with(ORDERS)
    + 'SELECT tx_id, "Time", row_number() OVER (ORDER BY "Time", tx_id) AS row FROM tx',
    "seeded_shuffle": f"""SELECT event_id AS tx_id,
    row_number() OVER (ORDER BY {_digest("shuffle", "event_id")}, event_id) AS row FROM events""",
    "smote_neighbours": _with(_SCALED_EMBED, _neighbours("WHERE Class = 1"))
    + "SELECT id, nn_rank::INTEGER AS nn_rank, nn_id, round(distance, 6) AS distance FROM near",
    "all_neighbours": _with(_SCALED_EMBED, _neighbours(""))
    + "SELECT id, nn_rank::INTEGER AS nn_rank, nn_id, round(distance, 6) AS distance FROM near",
    "smote_synthetic": _with(
        _SCALED_EMBED,
        _neighbours("WHERE Class = 1"),
        "numbered AS (SELECT *, row_number() OVER (ORDER BY tx_id) AS place FROM vectors WHERE Class = 1)",
        f"""picks AS (SELECT -i - 1 AS tx_id,
            floor({_uniform("base", "i")} * (SELECT count(*) FROM numbered)) + 1 AS place,
            floor({_uniform("neighbour", "i")} * 5) + 1 AS nn_rank, {_uniform("step", "i")} AS step
            FROM (SELECT unnest(range((SELECT floor({SMOTE_RATIO} * count(*) FILTER (Class = 0)
                  - count(*) FILTER (Class = 1))::BIGINT FROM tx))) AS i))""",
        """ends AS (SELECT picks.tx_id, a.tx_id AS base_id, near.nn_id, step, a.v AS a, b.v AS b
            FROM picks JOIN numbered a USING (place) JOIN near ON near.id = a.tx_id AND near.nn_rank = picks.nn_rank
            JOIN vectors b ON b.tx_id = near.nn_id)""",
    )
    + "SELECT tx_id, "
    + ", ".join(f"round(a[{i + 1}] + step * (b[{i + 1}] - a[{i + 1}]), 6) AS {c}" for i, c in enumerate(FEATURES))
    + ", base_id, nn_id, round(step, 6) AS step FROM ends",
    "smote_counts": _split(EMBED)
    + f"""SELECT Class, CASE WHEN Class = 0 THEN count(*) ELSE
    (SELECT floor({SMOTE_RATIO} * count(*))::BIGINT FROM split WHERE Class = 0 AND part = 'train') END AS n
    FROM split WHERE part = 'train' GROUP BY Class""",
    "confusion": _THREE
    + " UNION ALL ".join(
        f"SELECT model, {a} AS actual, {b} AS predicted, {c} AS n FROM cells"
        for a, b, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ),
    "binary_metrics": _THREE
    + """SELECT model, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM cells""",
    "roc_auc": _THREE + "SELECT model, round(roc_auc, 6) AS roc_auc FROM aucs",
    "roc_points": _THREE
    + """SELECT model, round(p, 6) AS threshold, round(fps / all_neg, 6) AS fpr, round(tps / all_pos, 6) AS tpr
    FROM cum WHERE place = 1 OR pos_next IS NULL OR pos <> pos_next OR neg <> neg_next
    UNION ALL SELECT model, NULL, 0, 0 FROM cells
    UNION ALL SELECT 'chance', NULL, 0, 0 UNION ALL SELECT 'chance', NULL, 1, 1""",
    "champion_select": _THREE + "SELECT * FROM best",
    "metrics_report": _THREE
    + """SELECT best.model AS best_model, best.roc_auc AS best_roc_auc, metrics.* FROM best, metrics""",
    "perturb_gaussian": _with(EMBED, *_noise_steps("tx", "tx_id", RECIPES["stolen_card"])[:1])
    + f"SELECT tx_id, {_rounded(V_COLUMNS)} FROM noisy",
    "sign_flip": _with(EMBED)
    + "SELECT tx_id, "
    + ", ".join(
        f"round(CASE WHEN {_uniform(f'flip-V{i}', 'tx_id')} < 0.08 THEN -V{i} ELSE V{i} END, 6) AS V{i}"
        for i in range(22, 29)
    )
    + " FROM tx",
    "amount_jitter": _with(EVENTS)
    + f"""SELECT tx_id, round(greatest(Amount * (1 + (-0.1 + {_uniform("amount", "tx_id")} * 0.2)), 0.01), 2)
    AS Amount FROM tx""",
    "time_drift": _with(EVENTS)
    + f"""SELECT tx_id, trunc(greatest("Time" + floor({_uniform("drift", "tx_id")} * 601) - 300, 0)) AS "Time" FROM tx""",
    "cross_noise": _with(EMBED)
    + "SELECT tx_id, "
    + ", ".join(
        f"round(V{i} + 0.05 * {_gaussian('cross', 'tx_id')} * (0.5 + 0.3 * {_gaussian_constant(f'factor-V{i}')}), 6) AS V{i}"
        for i in range(1, 5)
    )
    + " FROM tx",
    "plain_noise": _with(EMBED)
    + 'SELECT tx_id, trunc("Time") AS "Time", '
    + ", ".join(f"round({c} + 0.02 * {_gaussian(f'plain-{c}', 'tx_id')}, 6) AS {c}" for c in V_COLUMNS)
    + f", round(greatest(Amount + 0.02 * {_gaussian('plain-Amount', 'tx_id')}, 0.5), 2) AS Amount FROM tx",
    "csv_roundtrip": _scored(EVENTS) + f"SELECT row, {_PREDICTION} FROM numbered",
    "csv_quarantine": """SELECT event_id AS tx_id,
    CASE WHEN event_type NOT IN ('signup', 'view') THEN value END AS Amount,
    CASE WHEN event_type = 'view' THEN 'not a number: Amount' END AS reason FROM events""",
    "json_transactions": """SELECT c_custkey AS tx_id, 0::DOUBLE AS "Time", c_nationkey::DOUBLE AS V1, 0::DOUBLE AS V2,
    c_acctbal AS Amount, CASE WHEN c_acctbal < 0 THEN 'negative amount' END AS reject_reason FROM customer""",
    "stream_scores": _scored(EVENTS) + f"SELECT tx_id, {_PREDICTION} FROM scored",
}


def _permuted(source: str) -> str:
    """One pass of the keyed network over ``x``; the halves have a and b bits."""
    inner = f"(SELECT *, x >> b AS l0, x & ((1::BIGINT << b) - 1) AS r0 FROM {source})"
    for i in range(4):
        word = f"('0x' || substr(md5(concat('{SEED}|feistel|{i}|', r{i})), 1, 13))::BIGINT"
        width = "ab"[i % 2]
        inner = (
            f"(SELECT *, r{i} AS l{i + 1}, xor(l{i}, {word} & ((1::BIGINT << {width}) - 1)) AS r{i + 1} FROM {inner})"
        )
    return f"SELECT tx_id, row, n, a, b, (l4 << b) | r4 AS x FROM {inner}"


ORACLES["feistel_shuffle"] = f"""WITH RECURSIVE rows AS (
  SELECT event_id AS tx_id, row_number() OVER (ORDER BY event_id) AS row, count(*) OVER () AS n FROM events
), sized AS (
  SELECT *, greatest(2, length(bin(n - 1))) AS bits FROM rows
), numbered AS (
  SELECT tx_id, row, n, (bits // 2)::BIGINT AS a, (bits - bits // 2)::BIGINT AS b, (row - 1)::BIGINT AS x FROM sized
), walk AS (
  {_permuted("numbered")}
  UNION ALL
  {_permuted("(SELECT * FROM walk WHERE x >= n)")}
) SELECT tx_id, row, x + 1 AS place FROM walk WHERE x < n"""
ORACLES["medians_two_scans"] = ORACLES["column_medians"]
ORACLES["dedup_batches"] = _with(LINES) + 'SELECT DISTINCT "Time", V1, V2, Amount, Class FROM tx'
ORACLES["auc_from_histograms"] = (
    _THREE
    + """SELECT model, round(won / pairs, 6) AS auc, round(ties / pairs, 6) AS error,
    round((won - ties) / pairs, 6) AS low, round((won + ties) / pairs, 6) AS high FROM (
      SELECT model, sum(pos * (below + neg / 2)) AS won, sum(pos * neg / 2) AS ties,
        sum(pos)::DOUBLE * sum(neg) AS pairs
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY bin
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
            FROM (SELECT model, least(floor(p * 10000), 9999) AS bin, count(*) FILTER (Class = 1) AS pos,
                    count(*) FILTER (Class = 0) AS neg FROM judged GROUP BY ALL))
      GROUP BY model)"""
)
ORACLES["hourly_totals"] = (
    _scored(EVENTS)
    + """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS total_rows,
    count(*) FILTER (label = 'FRAUD') AS fraud_count, count(*) FILTER (label <> 'FRAUD') AS legit_count,
    round(count(*) FILTER (label = 'FRAUD') / count(*) * 100, 4) AS fraud_rate
    FROM scored JOIN events ON event_id = tx_id GROUP BY 1"""
)
ORACLES["stream_totals"] = ORACLES["batch_summary"]
