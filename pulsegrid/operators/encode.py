"""Choosing, filling and encoding model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.operators.skew import HotKeys, join_by_key, number_rows


def numeric_features(
    df: DataFrame,
    target: str = "steps_t",
    current: str = "steps",
    drop_current: bool = True,
    exclude: Sequence[str] = (),
) -> list[str]:
    """All numeric columns but the target and, by default, the current value."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found; build the features first")
    out = {target, *exclude, *([current] if drop_current else [])}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in out]


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0, as_float: bool = False) -> DataFrame:
    """Replace missing inputs by a constant, in one projection."""
    kind = "float" if as_float else "double"
    return df.withColumns({c: F.coalesce(F.col(c).cast(kind), F.lit(value).cast(kind)) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace missing inputs by the column mean."""
    inputs = df.withColumns({c: F.col(c).cast("double") for c in columns})
    imputer = Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns))
    return imputer.fit(inputs).transform(inputs)


def std_scaler(input_col: str = "features", output_col: str = "scaled") -> StandardScaler:
    """Divide by the standard deviation without centring, so sparse inputs stay sparse."""
    return StandardScaler(withMean=False, withStd=True, inputCol=input_col, outputCol=output_col)


def category_list(df: DataFrame, column: str) -> list:
    """Sorted categories, one row per column that the wide encoding is asked to make."""
    return sorted(row[0] for row in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, column: str = "user_id", categories: Sequence | None = None) -> DataFrame:
    """One 0/1 column per category but the first in sorted order; the original column stays.

    The wide form, for few categories; ``one_hot_vector`` has no bound on them. ``categories`` may be passed.
    """
    found = category_list(df, column) if categories is None else sorted(categories)
    dummies = {
        f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("tinyint") for v in found[1:]
    }
    return df.withColumns(dummies) if dummies else df


def one_hot_vector(
    df: DataFrame, column: str = "user_id", output: str = "user_id_vec", hot: HotKeys | None = None
) -> DataFrame:
    """The same encoding as a sparse vector: any number of categories, one column.

    Categories are numbered in sorted order by the distributed row numbering, from the last to the first, so
    that the encoder's dropped last category is the first in sorted order.
    """
    categories = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = number_rows(categories, [column], "_rank")
    count = numbered.count()
    if count < 2:  # nothing is left once the first category is dropped
        return df
    numbered = numbered.select(column, (F.lit(count - 1) - F.col("_rank")).cast("double").alias("_index"))
    model = OneHotEncoder(inputCol="_index", outputCol=output, dropLast=True).fit(numbered)
    return model.transform(join_by_key(df, numbered, column, "left", hot)).drop("_index")
