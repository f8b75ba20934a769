"""Column-expression builders (SCA-*).

Every builder returns a ``Column`` made of built-in functions only, so the
expressions stay inside whole-stage codegen; none of them is a Python UDF.
Arguments are column names or Columns, so the same builder serves the
clinical schema and any other star schema.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

ColumnOrName = Column | str

NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- bins (SCA-3/4/5/25)
def bin_labels(c: ColumnOrName, edges: Sequence[float], labels: Sequence[str],
               closed: str = "right") -> Column:
    """Label of the bin holding ``c``.

    ``closed='right'`` gives ``(e0, e1], (e1, e2], ...`` (the warehouse rule);
    ``closed='left'`` gives ``[e0, e1), ...`` except that the top bin also
    holds everything at or above its lower edge, as a threshold scorer does
    (``>= .6`` High, ``>= .3`` Medium, else Low). Values outside the bins and
    nulls give null.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = col(c)
    expr = None
    if closed == "right":
        for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
            cond = (x > F.lit(lo)) & (x <= F.lit(hi))
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    elif closed == "left":
        # threshold form: highest band first
        pairs = list(zip(edges[:-1], labels))
        for lo, lab in reversed(pairs[1:]):
            cond = x >= F.lit(lo)
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        expr = expr.when(x.isNotNull(), F.lit(pairs[0][1]))
    else:
        raise ValueError("closed must be 'right' or 'left'")
    return expr


def age_group(c: ColumnOrName) -> Column:
    return bin_labels(c, K.AGE_EDGES, K.AGE_LABELS, "right")


def medication_bin(c: ColumnOrName) -> Column:
    return bin_labels(c, K.MED_EDGES, K.MED_LABELS, "right")


def risk_level(c: ColumnOrName, closed: str = "right") -> Column:
    return bin_labels(c, K.RISK_EDGES, K.RISK_LABELS, closed)


def severity_band(c: ColumnOrName, high: float = 0.6, medium: float = 0.3,
                  labels: Sequence[str] = ("low", "medium", "high")) -> Column:
    """Strictly-greater bands of a ratio (``> .6`` high, ``> .3`` medium)."""
    x = col(c)
    return (F.when(x > F.lit(high), F.lit(labels[2]))
            .when(x > F.lit(medium), F.lit(labels[1]))
            .when(x.isNotNull(), F.lit(labels[0])))


# ---------------------------------------------------------------- lookups (SCA-2/24)
def lookup(c: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Value of ``mapping[c]``; missing keys (and null) give ``default``."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    hit = F.try_element_at(m, col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def age_numeric(c: ColumnOrName) -> Column:
    return lookup(c, K.AGE_MAP, K.AGE_DEFAULT).cast("int")


def display_name(c: ColumnOrName) -> Column:
    return F.coalesce(lookup(c, K.FEATURE_DISPLAY_NAMES), col(c))


def recommendation(level: ColumnOrName) -> Column:
    return lookup(level, K.RECOMMENDATIONS, K.RECOMMENDATIONS["Low"])


def level_colour(level: ColumnOrName) -> Column:
    return lookup(level, K.LEVEL_COLOURS, K.LEVEL_COLOUR_DEFAULT)


# ---------------------------------------------------------------- diagnosis (SCA-1/21)
def is_numeric_text(c: ColumnOrName) -> Column:
    return col(c).rlike(NUMERIC_TEXT)


def safe_double(c: ColumnOrName) -> Column:
    """Text -> double, or null when the text is not a plain decimal number.

    The ``rlike`` guard keeps Spark and SQL engines in agreement (Spark's own
    cast would accept forms such as ``12D``).
    """
    x = col(c)
    return F.when(is_numeric_text(x), F.trim(x).try_cast("double"))


def code_category(c: ColumnOrName) -> Column:
    """ICD-9 code text -> one of 11 categories."""
    x = F.trim(col(c).cast("string"))
    expr = F.when(col(c).isNull() | col(c).isin(*K.DIAG_NULL_TOKENS), F.lit(K.DIAG_DEFAULT))
    for prefix, label in K.DIAG_PREFIXES:
        expr = expr.when(x.startswith(F.lit(prefix)), F.lit(label))

    def ranges(num: Column) -> Column:
        out = F.when(num.isNull(), F.lit(K.DIAG_DEFAULT))
        for label, lo, hi, hi_inclusive, singles in K.DIAG_RANGES:
            cond = (num >= F.lit(float(lo))) & ((num <= F.lit(float(hi))) if hi_inclusive
                                                else (num < F.lit(float(hi))))
            for s in singles:
                cond = cond | (num == F.lit(float(s)))
            out = out.when(cond, F.lit(label))
        return out.otherwise(F.lit(K.DIAG_DEFAULT))

    # as a lambda's argument the number is parsed once, not once per comparison
    return expr.otherwise(F.get(F.transform(F.array(safe_double(x)), ranges), F.lit(0)))


# ---------------------------------------------------------------- flags (SCA-6..11/15)
def equals_flag(c: ColumnOrName, value) -> Column:
    """1 when ``c == value``; null counts as not equal."""
    return F.coalesce(col(c) == F.lit(value), F.lit(False)).cast("int")


def readmit_flag(c: ColumnOrName) -> Column:
    return equals_flag(c, K.READMIT_TOKEN)


def member_flag(c: ColumnOrName, values: Iterable) -> Column:
    return F.coalesce(col(c).isin(*list(values)), F.lit(False)).cast("int")


def not_no_flag(c: ColumnOrName) -> Column:
    """0 for text ``No``, else 1 (null counts as 1)."""
    return F.when(col(c) == F.lit("No"), F.lit(0)).otherwise(F.lit(1))


def above_flag(c: ColumnOrName, threshold) -> Column:
    """1 when ``c > threshold`` (a number or a Column); null gives 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(col(c) > t, F.lit(False)).cast("int")


def count_true(conds: Iterable[Column]) -> Column:
    return sum((F.when(c, F.lit(1)).otherwise(F.lit(0)) for c in conds), F.lit(0))


# ---------------------------------------------------------------- numbers (SCA-12..19)
def safe_number(c: ColumnOrName, default: float | None = 0) -> Column:
    x = safe_double(col(c).cast("string"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def row_sum(cols: Iterable[ColumnOrName]) -> Column:
    """Sum across columns with nulls skipped (all-null gives 0)."""
    return sum((F.coalesce(col(c), F.lit(0)) for c in cols), F.lit(0))


def clip(c: ColumnOrName, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def percent(c: ColumnOrName, digits: int = 1) -> Column:
    """``round(x * 100, digits)`` half-up, as the warehouse SQL rounds."""
    return F.round(col(c) * F.lit(100.0), digits)


def percent_even(c: ColumnOrName, digits: int = 1) -> Column:
    """``round(x * 100, digits)`` half-even, as numpy/pandas/Python round."""
    return F.bround(col(c) * F.lit(100.0), digits)


def share_percent(num: ColumnOrName, den: ColumnOrName, digits: int = 1) -> Column:
    """pandas form ``(num / den * 100).round(digits)``: divide first, half-even."""
    return F.bround(col(num).cast("double") / col(den) * F.lit(100.0), digits)


def capped_ratio(c: ColumnOrName, denom: float = 5.0, cap: float = 1.0) -> Column:
    return F.least(col(c) / F.lit(float(denom)), F.lit(float(cap)))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` or null when ``den`` is 0 or null."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den), F.lit(0)).cast("double"))


# ---------------------------------------------------------------- text/time (SCA-22/23/26/27)
def bucket_text(c: ColumnOrName, width: int = 10) -> Column:
    """``[a-a+width)`` from the number itself (not floored), as the record
    generator writes it; ``37`` gives ``[37-47)``, which no age map holds."""
    a = col(c).cast("int")
    return F.format_string("[%d-%d)", a, a + F.lit(width))


def iso_text(ts: ColumnOrName) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def month_start(ts: ColumnOrName) -> Column:
    return F.trunc(col(ts), "month")


def join_list(c: ColumnOrName, sep: str = ",") -> Column:
    return F.array_join(col(c), sep)


def split_list(c: ColumnOrName, sep: str = ",") -> Column:
    return F.split(col(c), sep)


def hist_bin(c: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, n: int) -> Column:
    """1-based equal-width bin in ``[1, n]``; the maximum lands in bin n."""
    x, a, b = col(c), col(lo), col(hi)
    width = (b - a) / F.lit(float(n))
    raw = F.floor((x - a) / width).cast("int") + F.lit(1)
    return F.when(b == a, F.lit(1)).otherwise(F.least(raw, F.lit(n)))


def hash_rank(key: ColumnOrName, seed: int = 42) -> Column:
    """Deterministic integer hash in ``[0, 2^31)`` used for samples and splits.

    Linear-congruential step on the key (reduced mod 2^31 first, so no 64-bit
    overflow for any key), reproducible in any SQL engine.
    """
    k = col(key).cast("long")
    # reduce first so the product stays below 2^62 for any 64-bit key
    return F.pmod(F.pmod(k, F.lit(2147483648)) * F.lit(1103515245) + F.lit(seed),
                  F.lit(2147483648))


# ---------------------------------------------------------------- scores (SCO-1/2)
def heuristic_score(age: ColumnOrName, inpatient: ColumnOrName, meds: ColumnOrName) -> Column:
    """.1 + min(age/200, .2) + min(inpatient*.15, .3) + min(meds/50, .15), rounded
    half-even to 4 decimals (Python ``round``), capped at .95."""
    base = (F.lit(0.1)
            + F.least(col(age) / F.lit(200.0), F.lit(0.2))
            + F.least(col(inpatient) * F.lit(0.15), F.lit(0.3))
            + F.least(col(meds) / F.lit(50.0), F.lit(0.15)))
    return F.least(F.bround(base, 4), F.lit(0.95))


def fallback_score(age_grp: ColumnOrName, inpatient: ColumnOrName, meds: ColumnOrName) -> Column:
    """clip(.1 + age-group proxy/10 + inpatient*.08 + meds/100, .01, .99), rounded
    half-even to 4 decimals (numpy ``round``)."""
    proxy = lookup(age_grp, K.AGE_GROUP_PROXY, K.AGE_GROUP_PROXY_DEFAULT).cast("double")
    raw = (F.lit(0.1) + proxy / F.lit(10.0)
           + col(inpatient) * F.lit(0.08) + col(meds) / F.lit(100.0))
    return F.bround(clip(raw, 0.01, 0.99), 4)
