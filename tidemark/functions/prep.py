"""Typing, missing values, alignment and melting of feature columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def finite(x: Column) -> Column:
    """``x`` as double; null, NaN and infinities are missing (null)."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def feature_names(df: DataFrame, features: list[str] | None = None, expected: list[str] | None = None) -> list[str]:
    """The feature columns, checked: numeric or boolean, and by name the expected ones in their order."""
    names = list(df.columns if features is None else features)
    for n in names:
        kind = df.schema[n].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise TypeError(f"column {n!r} is {kind.simpleString()}; features must be numeric or boolean")
    if len(set(names)) != len(names):
        raise ValueError("feature names must be unique")
    if expected is not None:
        missing, extra = [n for n in expected if n not in names], [n for n in names if n not in expected]
        if missing or extra:
            raise ValueError(f"features differ from the reference: missing {missing}, unexpected {extra}")
        names = list(expected)
    return names


def clean(df: DataFrame, features: list[str], keep: list[str] = []) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keep], *[finite(F.col(f"`{f}`")).alias(f) for f in features])


def melt(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) with missing values as null."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), finite(F.col(f"`{f}`")).alias("value")) for f in features])
    return df.select(F.explode(cells).alias("c")).select("c.feature", "c.value")


def subsample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows (all, if fewer), chosen by a hash of the key: the same rows at each run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(f"`{key}`"))), F.col(f"`{key}`")).limit(n)


def align_all(frames: list[DataFrame], weight: str = "w") -> DataFrame:
    """Rows of all frames; absent weights are 1."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.withColumn(weight, F.coalesce(weight, F.lit(1.0))) if weight in out.columns else out
