"""Cleaning expressions (P1-P16). Pure column expressions: no UDF, codegen'd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label strings counted as positive / negative by the label maps.
POSITIVE_LABELS = ("Yes", "True", "1")
NEGATIVE_LABELS = ("No", "False", "0")
MISSING = "Missing"

# Text accepted as a number: decimal with optional exponent, or inf / infinity / nan.
# Anything else (blank, 'abc', '12.5d') is not a number, as in pandas.to_numeric(errors='coerce').
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_TEXT = r"^[+-]?([Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?|[Nn][Aa][Nn])$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_default0(c, positives=POSITIVE_LABELS) -> Column:
    """Yes/True/1 (as text) -> 1, everything else including null -> 0."""
    return F.when(_col(c).cast("string").isin(*positives), F.lit(1)).otherwise(F.lit(0)).cast("int")


def label_strict(c, positive: str = "Yes", negative: str = "No") -> Column:
    """Yes -> 1, No -> 0, anything else stays null."""
    x = _col(c).cast("string")
    return F.when(x == positive, F.lit(1)).when(x == negative, F.lit(0)).cast("int")


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    """Drop columns, silently skipping absent names."""
    return df.drop(*[c for c in cols if c in df.columns])


def to_number(c, fill: float | None = None) -> Column:
    """P4 (fill=None, bad text -> null) and P5 (fill=0.0)."""
    t = F.trim(_col(c).cast("string"))
    ok = t.rlike(NUMBER_TEXT) | t.rlike(SPECIAL_TEXT)
    v = F.when(ok, t.try_cast("double"))
    v = F.nanvl(v, F.lit(None).cast("double"))  # NaN counts as missing
    return F.coalesce(v, F.lit(float(fill))) if fill is not None else v


def fill_category(c, filler: str = MISSING) -> Column:
    """Categorical null -> 'Missing', everything as text."""
    return F.coalesce(_col(c).cast("string"), F.lit(filler))


def clean_frame(df: DataFrame, numeric=(), categorical=(), fill: float | None = 0.0,
                filler: str = MISSING) -> DataFrame:
    """P4/P5 + P6 over many columns in one projection."""
    num, cat = set(numeric), set(categorical)
    out = []
    for name in df.columns:
        if name in num:
            out.append(to_number(name, fill).alias(name))
        elif name in cat:
            out.append(fill_category(name, filler).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def drop_null_rows(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a null in any of the named columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.na.drop(subset=present) if present else df


def drop_null_label(df: DataFrame, label: str) -> DataFrame:
    """P8."""
    return df.filter(F.col(label).isNotNull())


def split_back(df: DataFrame, split_col: str = "split", tag: str = "train") -> DataFrame:
    """The rows of one side of a tagged union."""
    return df.filter(F.col(split_col) == tag)


def confident(df: DataFrame, score: str = "score", high: float = 0.985, low: float = 0.015) -> DataFrame:
    """Rows at or beyond either confidence threshold (both inclusive)."""
    return df.filter((F.col(score) >= high) | (F.col(score) <= low))


def clip(c, lo: float = 0.0001, hi: float = 0.9999) -> Column:
    """Null and NaN are no score and give null."""
    x = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def feature_dim(df: DataFrame, vector_col: str) -> int:
    """Width of an assembled feature vector, read from its ML attribute metadata."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return sum(len(v) for v in meta.get("attrs", {}).values())
