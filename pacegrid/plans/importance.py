"""Permutation importance: how much a model's log error grows when one feature is shuffled over the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.operators.ordered import global_ordinal
from pacegrid.operators.skew import Profile
from pacegrid.operators.stats import squared_log_error
from pacegrid.session import settle_sized


def _error(label: str, prediction: str) -> Column:
    return squared_log_error(F.col(label), F.greatest(F.col(prediction), F.lit(0.0)))


def permuted(df: DataFrame, columns: Sequence[str], keys: Sequence[str], out: str, salt: int = 0) -> DataFrame:
    """Add as struct ``out`` the ``columns`` of another row: every row of the table gives its values exactly once.

    Rows are numbered in two orders by hashes of their keys, and the n-th of one order gets the values of
    the n-th of the other. Rows of equal keys come in the order of their values. The orders are the
    same in every run; another ``salt`` gives others. Large tables are numbered by sorted ranges, and the
    numbers they are joined by are unique, so no key is hot.
    """
    rows, size = settle_sized(df)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    known = Profile({(): size.rows})

    def numbered(which: str) -> DataFrame:
        hashed = rows.withColumn("__order", F.md5(F.concat(F.lit(f"{salt}{which}|"), text)))
        needless = ["__order", *[c for c in df.columns if which == "b" and c not in columns]]
        return global_ordinal(hashed, ["__order", *dict.fromkeys([*keys, *columns])], "__row", known, needless)

    givers = numbered("b").select("__row", F.struct(*columns).alias(out))
    return numbered("a").join(givers, "__row").drop("__row")


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame],
    df: DataFrame,
    label: str,
    features: Sequence[str],
    keys: Sequence[str],
    prediction: str = "prediction",
    salt: int = 0,
) -> DataFrame:
    """``feature, rmsle, permuted_rmsle, importance, scored, unscored``: the growth of the log error by feature.

    ``predict`` adds a column of predictions, as a fitted model's ``transform`` does. Rows that have no
    log error, before or after, are unscored. Both errors of a feature are added up over the same rows
    in the same order, so one that the model does not read has an importance of exactly 0. Each task
    works through one copy of its rows for each feature.
    """
    rows = permuted(df.select(label, *dict.fromkeys([*keys, *features])), features, keys, "__other", salt)
    before = predict(rows).select(label, *features, "__other", _error(label, prediction).alias("__before"))
    copies = before.withColumn("__feature", F.explode(F.array(*[F.lit(f) for f in features])))
    changed = {f: F.when(F.col("__feature") == f, F.col("__other")[f]).otherwise(F.col(f)) for f in features}
    after = predict(copies.withColumns(changed).drop("__other")).withColumn("__after", _error(label, prediction))
    both = F.col("__before").isNotNull() & F.col("__after").isNotNull()
    scores = after.groupBy(F.col("__feature").alias("feature")).agg(
        F.sqrt(F.avg(F.when(both, F.col("__before")))).alias("rmsle"),
        F.sqrt(F.avg(F.when(both, F.col("__after")))).alias("permuted_rmsle"),
        F.count_if(both).alias("scored"),
        F.count_if(~both).alias("unscored"),
    )
    gain = F.col("permuted_rmsle") - F.col("rmsle")
    names = ("feature", "rmsle", "permuted_rmsle", "importance", "scored", "unscored")
    return scores.withColumn("importance", gain).select(*names)
