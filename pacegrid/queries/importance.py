"""Permutation importance of a formula, which SQL can follow, and of fitted trees."""

from pyspark.sql import functions as F

from pacegrid.functions.numbers import rounded
from pacegrid.plans import models as M
from pacegrid.plans.importance import permutation_importance
from pacegrid.queries.base import query
from pacegrid.queries.models import CATEGORICAL, KEY, KEY_SQL, LABEL, NUMERIC, parts

FORMULA = "1500 * {quantity} * (1 - {discount})"
_TEXT = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_VALUES = "l_quantity, l_discount, l_tax"


def _formula(quantity: str = "l_quantity", discount: str = "l_discount") -> str:
    return FORMULA.format(quantity=quantity, discount=discount)


def _scores_sql() -> str:
    changed = {
        "l_quantity": _formula(quantity="o.l_quantity", discount="r.l_discount"),
        "l_discount": _formula(quantity="r.l_quantity", discount="o.l_discount"),
        "l_tax": _formula(quantity="r.l_quantity", discount="r.l_discount"),
    }
    plain = changed["l_tax"]
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, sqrt(avg(pow(ln(1 + r.price) - ln(1 + {plain}), 2))) AS rmsle,
            sqrt(avg(pow(ln(1 + r.price) - ln(1 + {p}), 2))) AS permuted_rmsle, count(*) AS scored
            FROM taking r JOIN giving o USING (n)"""
        for f, p in changed.items()
    )


@query(
    "permutation_importance",
    f"""
    WITH taking AS (
      SELECT l_extendedprice AS price, {_VALUES},
             row_number() OVER (ORDER BY md5('0a|' || {_TEXT}), {KEY_SQL}, {_VALUES}) AS n FROM lineitem),
    giving AS (
      SELECT {_VALUES}, row_number() OVER (ORDER BY md5('0b|' || {_TEXT}), {KEY_SQL}, {_VALUES}) AS n FROM lineitem),
    scores AS ({_scores_sql()})
    SELECT feature, round(rmsle, 8) AS rmsle, round(permuted_rmsle, 8) AS permuted_rmsle,
           round(permuted_rmsle - rmsle, 7) AS importance, scored, CAST(0 AS BIGINT) AS unscored
    FROM scores
    """,
)
def formula_importance(t):
    def predict(df):
        return df.withColumn("prediction", F.expr(_formula()))

    table = permutation_importance(predict, t.lineitem, LABEL, NUMERIC, KEY)
    digits = {"rmsle": 8, "permuted_rmsle": 8, "importance": 7}
    return table.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query("tree_permutation_importance")
def tree_importance(t):
    """Trees of 20 rounds, fitted on the train part and judged on the rest."""
    train, valid, _ = parts(t)
    model = M.fit_trees(train, LABEL, NUMERIC, CATEGORICAL)
    return permutation_importance(model.transform, valid, LABEL, [*NUMERIC, *CATEGORICAL], KEY, "predict")
