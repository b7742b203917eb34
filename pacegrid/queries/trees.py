"""Boosted trees of one split a round on a category of three values: every round has a closed form.

The twin is a recursion over rounds. A round parts one value from the other two, where that leaves the
least variance, and moves either side by its mean residual; after the first round by that times the
rate times two, as the slope of a squared error is twice the residual.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pacegrid.functions.numbers import rounded
from pacegrid.operators.targets import ordered_target
from pacegrid.plans import models as M
from pacegrid.plans import staged
from pacegrid.queries.base import query
from pacegrid.queries.models import KEY, KEY_SQL, LABEL, PARTS_SQL, parts

FLAG = ["l_returnflag"]
ROUNDS, RATE = 6, 0.3
GRID = M.parameter_grid(maxIter=(2, 4, 6), maxDepth=(1,), stepSize=(0.1, 0.3))


def rounds_sql(rates: str) -> str:
    """``rate, round, A, N, R``: what is predicted for each flag after each round."""
    moves = ", ".join(
        f"p{v} + w * CASE best " + " ".join(
            f"WHEN '{b}' THEN {f'r{v}' if b == v else f'(total - n{b} * r{b}) / (n - n{b})'}" for b in "ANR"
        ) + " END"
        for v in "ANR"
    )
    gains = {v: f"n{v} * pow(r{v} - total / n, 2) / (n - n{v})" for v in "ANR"}
    best = f"CASE WHEN {gains['A']} >= greatest({gains['N']}, {gains['R']}) THEN 'A' WHEN {gains['N']} >= {gains['R']} THEN 'N' ELSE 'R' END"
    flags = ", ".join(
        f"count(*) FILTER (l_returnflag = '{v}')::DOUBLE AS n{v}, avg(l_extendedprice) FILTER (l_returnflag = '{v}') AS m{v}" for v in "ANR"
    )
    return f"""{PARTS_SQL.replace("WITH p AS", "WITH RECURSIVE p AS")},
    flags AS (SELECT {flags} FROM p WHERE fitted),
    rounds AS (
      SELECT rate, 0 AS round, 0::DOUBLE AS pA, 0::DOUBLE AS pN, 0::DOUBLE AS pR FROM (SELECT unnest({rates})::DOUBLE AS rate)
      UNION ALL
      SELECT rate, round + 1, {moves} FROM (
        SELECT *, {best} AS best FROM (
          SELECT *, nA + nN + nR AS n, nA * rA + nN * rN + nR * rR AS total FROM (
            SELECT rounds.*, nA, nN, nR, mA - pA AS rA, mN - pN AS rN, mR - pR AS rR,
                   CASE round WHEN 0 THEN 1 ELSE 2 * rate END AS w
            FROM rounds, flags WHERE round < {ROUNDS})))),
    scores AS (
      SELECT rate, round, sqrt(avg(pow(ln(1 + l_extendedprice) - ln(1 + CASE l_returnflag WHEN 'A' THEN pA WHEN 'N' THEN pN ELSE pR END), 2))) AS rmsle,
             count(*) AS scored
      FROM p, rounds WHERE NOT fitted AND round > 0 GROUP BY ALL)
    """


def _curve(t):
    train, valid, _ = parts(t)
    return valid, *staged.fit_best_round(train, valid, LABEL, [], FLAG, maxIter=ROUNDS, maxDepth=1, stepSize=RATE)


@query(
    "staged_curve",
    f"""{rounds_sql(f"[{RATE}]")}
    SELECT round, round(rmsle, 8) AS rmsle, scored, CAST(0 AS BIGINT) AS unscored FROM scores
    """,
)
def staged_curve(t):
    _, _, curve = _curve(t)
    return curve.withColumn("rmsle", rounded(F.col("rmsle"), 8))


@query(
    "best_round_trees",
    f"""{rounds_sql(f"[{RATE}]")},
    kept AS (SELECT r.* FROM rounds r JOIN scores s USING (rate, round) ORDER BY rmsle, round LIMIT 1)
    SELECT {KEY_SQL}, round AS rounds, round(CASE l_returnflag WHEN 'A' THEN pA WHEN 'N' THEN pN ELSE pR END, 3) AS predict
    FROM p, kept WHERE NOT fitted
    """,
)
def best_round_trees(t):
    valid, model, _ = _curve(t)
    rounds = F.lit(len(model.stages[-1].trees))
    return model.transform(valid).select(*KEY, rounds.alias("rounds"), rounded(F.col("predict"), 3).alias("predict"))


@query(
    "staged_search",
    f"""{rounds_sql("[0.1, 0.3]")}
    SELECT 'maxIter=' || round || ', maxDepth=1, stepSize=' || rate AS model_id, round(rmsle, 8) AS rmsle,
           rank() OVER (ORDER BY round(rmsle, 8)) AS place
    FROM scores WHERE round IN (2, 4, 6)
    """,
)
def staged_search(t):
    """The search as ``grid_search_scores`` runs it, where SQL can follow each round."""
    train, valid, _ = parts(t)
    table = staged.search(train, valid, LABEL, [], FLAG, GRID).table
    table = table.select("model_id", rounded(F.col("rmsle"), 8).alias("rmsle"))
    # one row per grid point
    return table.withColumn("place", F.rank().over(Window.orderBy("rmsle")).cast("bigint"))


@query(
    "ordered_target_codes",
    f"""{PARTS_SQL},
    fit AS (SELECT * FROM p WHERE fitted),
    prior AS (SELECT avg(l_extendedprice) AS m FROM fit),
    sums AS (SELECT l_suppkey AS s, sum(l_extendedprice) AS y, count(*) AS n FROM fit GROUP BY 1),
    before AS (
      SELECT {KEY_SQL}, coalesce(sum(l_extendedprice) OVER w, 0) AS y, count(*) OVER w AS n FROM fit
      WINDOW w AS (PARTITION BY l_suppkey ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), {KEY_SQL},
                   l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    rest AS (
      SELECT {KEY_SQL}, coalesce(y, 0) AS y, coalesce(n, 0) AS n FROM p LEFT JOIN sums ON s = l_suppkey WHERE NOT fitted)
    SELECT {KEY_SQL}, round((y + 5 * m) / (n + 5), 3) AS code FROM (SELECT * FROM before UNION ALL SELECT * FROM rest), prior
    """,
)
def ordered_target_codes(t):
    """A supplier's mean price in the rows before, five rows of the overall mean coming first."""
    _, _, df = parts(t)
    coded = ordered_target(df, "l_suppkey", LABEL, "code", F.col("part") == "train", KEY, smoothing=5.0)
    return coded.select(*KEY, rounded(F.col("code"), 3).alias("code"))
