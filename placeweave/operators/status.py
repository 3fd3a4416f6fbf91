"""The status column and everything counted or filtered by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = "statusState"
# Texts of the status column.
SUCCESS, FAILURE = "Thành công", "Lỗi"


def after_hit(status: Column) -> Column:
    return F.when(status == "", SUCCESS).otherwise(status)


def after_miss(status: Column, suffix: str) -> Column:
    return F.when(status.isin("", SUCCESS), f"{FAILURE} {suffix}").otherwise(F.concat(status, F.lit(f";{suffix}")))


def is_success() -> Column:
    return F.col(STATUS).eqNullSafe(F.lit(SUCCESS))


def filtered(df: DataFrame, mode: str) -> DataFrame:
    """success, error (null counts as error), anything else: all."""
    return {"success": df.filter(is_success()), "error": df.filter(~is_success())}.get(mode, df)


def export_rows(df: DataFrame, mode: str) -> DataFrame:
    return filtered(df, mode).drop(STATUS, "id")


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole * 100 with one decimal, half to even as the double's exact value has it; whole 0: the given percentage."""
    x = part / F.greatest(whole, F.lit(1)) * 100
    tenths = F.floor(x * 10)
    middle = 2 * tenths + 1  # twentieths half way to the next tenth
    # 20 x - middle without rounding: both differences lie within a factor of two of their terms.
    over = (x * 16 - middle) + x * 4
    up = (over > 0) | ((over == 0) & (tenths % 2 == 1))
    return F.when(whole == 0, F.lit(empty)).otherwise((tenths + F.when(up, 1).otherwise(0)) / F.lit(10.0))


def share(part: int, whole: int, empty: float = 0.0) -> float:
    """percent of two numbers."""
    return round(part / whole * 100, 1) if whole else empty


def tallies() -> list[Column]:
    """total and success, as aggregates that can also be observed while rows are written."""
    return [F.count("*").alias("total"), F.count_if(is_success()).alias("success")]


def counts(df: DataFrame, empty: float = 0.0) -> DataFrame:
    """total, success, fail, percent (empty input: the given percentage)."""
    found = df.agg(*tallies())
    return found.select("total", "success", (F.col("total") - F.col("success")).alias("fail"), percent(F.col("success"), F.col("total"), empty).alias("percent"))
