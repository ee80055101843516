"""Row-wise feature expressions (E1-E18). All are built-in column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnforge.functions.clean import MISSING


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def charge_residual(total, monthly, tenure) -> Column:
    """E1 / E7 (SurCharge): total - monthly * tenure."""
    return _col(total) - _col(monthly) * _col(tenure)


def residual_sign(total, monthly, tenure) -> Column:
    """Sign of the residual as a number (-1.0, 0.0, 1.0)."""
    return F.signum(charge_residual(total, monthly, tenure))


def residual_sign_text(total, monthly, tenure) -> Column:
    """The sign as a category ('-1.0', '0.0', '1.0')."""
    return residual_sign(total, monthly, tenure).cast("string")


def relative_residual(total, monthly, tenure) -> Column:
    """Residual / (monthly * tenure + 1); a zero denominator gives null."""
    den = _col(monthly) * _col(tenure) + F.lit(1.0)
    return F.try_divide(charge_residual(total, monthly, tenure), F.nullif(den, F.lit(0.0)))


def plus_one_ratio(num, den) -> Column:
    """Num / (den + 1); a zero denominator gives null."""
    return F.try_divide(_col(num), F.nullif(_col(den) + F.lit(1.0), F.lit(0.0)))


def residual_features(total: str, monthly: str, tenure: str) -> dict[str, Column]:
    """E1, E2, E4, E5, E6 as named columns (one projection)."""
    return {
        "charge_residual": charge_residual(total, monthly, tenure),
        "charge_residual_sign": residual_sign(total, monthly, tenure),
        "charge_residual_relative": relative_residual(total, monthly, tenure),
        "monthly_over_total": plus_one_ratio(monthly, total),
        "tenure_over_monthly": plus_one_ratio(tenure, monthly),
    }


def cross(*cols, sep: str = "_", null_rule: str = "propagate", filler: str = MISSING,
          null_text: str = "nan") -> Column:
    """Join several category columns into one.

    null_rule:
      'propagate' - cross first, fill after: any null makes the whole cross `filler`
      'fill'      - fill each part with `filler` first ('Missing_X_b')
      'text'      - each null part becomes `null_text` ('nan_b_c')
    """
    parts = [_col(c).cast("string") for c in cols]
    if null_rule == "fill":
        parts = [F.coalesce(p, F.lit(filler)) for p in parts]
    elif null_rule == "text":
        parts = [F.coalesce(p, F.lit(null_text)) for p in parts]
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(p)
    joined = F.concat(*pieces)  # concat propagates null (concat_ws would skip it)
    return F.coalesce(joined, F.lit(filler)) if null_rule == "propagate" else joined


def pair_names(cols, prefix: str = "PAIR_", mid: str = "_x_") -> list[tuple[str, str, str]]:
    return [(f"{prefix}{a}{mid}{b}", a, b) for a, b in itertools.combinations(cols, 2)]


def all_pair_crosses(cols, sep: str = "_X_", null_rule: str = "fill", filler: str = MISSING) -> dict[str, Column]:
    """Every unordered pair of columns crossed (C(n, 2) columns, wide form)."""
    return {name: cross(a, b, sep=sep, null_rule=null_rule, filler=filler) for name, a, b in pair_names(cols)}


def count_equal(cols, value: str = "Yes") -> Column:
    """How many of the columns equal `value` (null counts as not equal)."""
    terms = [F.coalesce((_col(c) == F.lit(value)).cast("int"), F.lit(0)) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def report_features(total: str, monthly: str, tenure: str) -> dict[str, Column]:
    """Named only in the reports; formulas are our own reading of their names."""
    expected = _col(monthly) * _col(tenure)
    return {
        "avg_charge_per_tenure": plus_one_ratio(total, tenure),
        "expected_total_charges": expected,
        "charge_discrepancy": _col(total) - expected,
        "pct_discrepancy": F.try_divide(_col(total) - expected, F.nullif(expected + F.lit(1.0), F.lit(0.0))),
    }


def service_features(service_cols, monthly: str, value: str = "Yes") -> dict[str, Column]:
    """Number of services and charge per service."""
    n = count_equal(service_cols, value)
    return {"num_services": n, "monthly_per_service": plus_one_ratio(monthly, n.cast("double"))}


def household_flags(partner, dependents, senior, yes: str = "Yes") -> dict[str, Column]:
    """is_family = partner and dependents; is_vulnerable = senior, no partner, no dependents."""
    p = F.coalesce(_col(partner) == F.lit(yes), F.lit(False))
    d = F.coalesce(_col(dependents) == F.lit(yes), F.lit(False))
    s = F.coalesce(_col(senior).cast("string").isin("1", "1.0", yes), F.lit(False))
    return {"is_family": (p & d).cast("int"), "is_vulnerable": (s & ~p & ~d).cast("int")}


def listed_crosses(pairs, sep: str = "_", null_rule: str = "propagate") -> dict[str, Column]:
    """An explicit list of column pairs, crossed first and filled after: a null in either makes the
    whole cross `Missing`. Columns are named a_b."""
    return {f"{a}_{b}": cross(a, b, sep=sep, null_rule=null_rule) for a, b in pairs}
