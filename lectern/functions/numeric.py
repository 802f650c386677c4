"""Numeric coercion, scores and distances as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.fixed_values import LOGIT_CLIP

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(value: Column | str) -> Column:
    """Double, or null for anything that is not a plain number (NaN included)."""
    text = _col(value).cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_number_decimal_comma(value: Column | str) -> Column:
    """As :func:`to_number` after turning decimal commas into points."""
    return to_number(F.replace(_col(value).cast("string"), F.lit(","), F.lit(".")))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: replace it by null in every floating column."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def skip_flag(count: Column | str) -> Column:
    """1 when the fixation count is null or zero."""
    return (F.coalesce(_col(count), F.lit(0)) == 0).cast("int")


def refixations(count: Column | str) -> Column:
    """Fixations beyond the first, never negative."""
    return F.greatest(F.coalesce(_col(count), F.lit(0)) - 1, F.lit(0))


def log1p_positive(value: Column | str) -> Column:
    col = _col(value)
    return F.when(col > 0, F.log1p(col))


def sigmoid(score: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(score)))


def logit(probability: Column | str, clip: float = LOGIT_CLIP) -> Column:
    p = F.least(F.greatest(_col(probability), F.lit(clip)), F.lit(1.0 - clip))
    q = F.least(F.greatest(1.0 - _col(probability), F.lit(clip)), F.lit(1.0 - clip))
    return F.ln(p / q)


def sign_class(value: Column | str) -> Column:
    col = _col(value)
    return F.when(col > 0, "positive").when(col < 0, "negative").when(col.isNotNull(), "zero")


def right_closed_bin(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Bin with right-closed intervals, the lowest edge included; null outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    col = _col(value)
    out = F.when((col < edges[0]) | col.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(col <= edge, label)
    return out


def interval_labels(edges: list[float]) -> list[str]:
    return [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:])]


def threshold_category(
    value: Column, strong: float, promising: float, weak: float, p_value: Column | None = None, p_limit: float = 0.1
) -> Column:
    """Signal category by descending thresholds; a large p-value lowers the two best ones to weak."""
    doubtful = F.coalesce(p_value > p_limit, F.lit(False)) if p_value is not None else F.lit(False)
    return (
        F.when(value.isNull(), "blocked_by_data_quality")
        .when((value >= strong) & ~doubtful, "strong_signal")
        .when((value >= promising) & ~doubtful, "promising_signal")
        .when(value >= weak, "weak_signal")
        .otherwise("not_supported")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when either side is null or has zero norm."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1.0 - dot(a, b) / scale)


def pearson(x: Column, y: Column, minimum: int = 3) -> Column:
    """Pairwise-complete correlation as an aggregate; null below ``minimum`` pairs or on a constant side."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    usable = (F.count(px) >= minimum) & (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(usable, F.try_divide(F.covar_pop(px, py), spread))


def slope(y: Column, x: Column, minimum: int = 3) -> Column:
    """OLS slope as an aggregate; null below ``minimum`` pairs or on constant ``x``."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    usable = (F.count(px) >= minimum) & (F.min(px) < F.max(px))
    return F.when(usable, F.try_divide(F.covar_pop(px, py), F.var_pop(px)))
