"""Column expressions of the clinical features. All built-in Spark functions:
they run inside whole-stage codegen, no Python per row.

Null rules: NaN is turned into NULL at the boundary (``nan_to_null``), text
that is not a plain decimal number parses to NULL, comparisons with a missing
value count as false (``coalesce(cond, false)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelens import config as C

# A plain decimal number with optional sign, fraction and exponent, with
# surrounding whitespace. Text outside this shape (units, NaN, infinity,
# underscores) is not a number.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
EDGE_SPACE = r"^\s+|\s+$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def parse_number(c) -> Column:
    """Text -> double, anything unparseable -> NULL (coercing parse)."""
    t = col(c).cast("string")
    # The cast trims surrounding whitespace itself; the pattern keeps out what
    # the cast would also accept (type suffixes, hex, NaN, infinity).
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))


def parse_timestamp(c, fmt: str | None = None, dtype: str = "string") -> Column:
    """Text is parsed, bad text -> NULL; columns of another ``dtype`` pass through."""
    c = col(c)
    if dtype != "string":
        return c
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def encode(c, codes: dict[str, int], collation: str | None = None) -> Column:
    """Category text -> code; unknown or NULL -> 0. Text compares exactly, or by
    ``collation`` (``UTF8_LCASE_RTRIM``: blind to case and trailing spaces)."""
    c = F.collate(col(c), collation) if collation else col(c)
    expr = None
    for text, code in codes.items():
        expr = F.when(c == text, F.lit(code)) if expr is None else expr.when(c == text, F.lit(code))
    return expr.otherwise(F.lit(0))


def decode(c, texts: dict[int, str]) -> Column:
    """Code -> display text; unknown code -> NULL."""
    c = col(c)
    expr = None
    for code, text in texts.items():
        expr = F.when(c == code, F.lit(text)) if expr is None else expr.when(c == code, F.lit(text))
    return expr


def range_guard(c, lo: float, hi: float) -> Column:
    """Keep values within [lo, hi], else NULL (NaN fails the test)."""
    c = col(c)
    return F.when(c.between(lo, hi), c)


def bmi(weight="PESO", height="TALLA") -> Column:
    w, h = col(weight), col(height)
    return F.when(w.isNotNull() & h.isNotNull() & (h > 0), w / F.pow(h / 100.0, 2))


def band(c, bands, top: str) -> Column:
    """NULL or NaN -> 'Sin dato', then ascending exclusive upper bounds."""
    c = col(c)
    expr = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(C.NO_DATA))
    for upper, label in bands:
        expr = expr.when(c < upper, F.lit(label))
    return expr.otherwise(F.lit(top))


def bmi_band(c="IMC") -> Column:
    return band(c, C.BMI_BANDS, C.BMI_TOP)


def age_band(c="EDAD") -> Column:
    return band(c, C.AGE_BANDS, C.AGE_TOP)


def mean_arterial(sys_col="PRESION_SISTOLICA", dia_col="PRESION_DIASTOLICA") -> Column:
    return (col(sys_col) + 2 * col(dia_col)) / 3


def systolic_lenient(c="PRESION_ARTERIAL") -> Column:
    """Service rule: text before the first '/', parsed; no '/' needed, no range check."""
    return parse_number(F.get(F.split(col(c).cast("string"), "/"), 0))


def same_cause(cause="CAUSA_INGRESO") -> Column:
    return F.coalesce(col(cause) == C.SAME_CAUSE_CODE, F.lit(False))


def within_days(days, limit: int = C.READMISSION_DAYS) -> Column:
    return F.coalesce(col(days) <= limit, F.lit(False))


def readmission(same, within) -> Column:
    return (col(same) & col(within)).cast("int")


def risk_tier(p) -> Column:
    p = col(p)
    expr = None
    for lower, tier in C.RISK_TIERS:
        expr = F.when(p >= lower, F.lit(tier)) if expr is None else expr.when(p >= lower, F.lit(tier))
    return expr.otherwise(F.lit(C.RISK_BOTTOM))


def tier_rank(t) -> Column:
    t = col(t)
    expr = None
    for i, tier in enumerate(C.RISK_ORDER):
        expr = F.when(t == tier, F.lit(i)) if expr is None else expr.when(t == tier, F.lit(i))
    return expr


def mean_of(*cols) -> Column:
    total = col(cols[0])
    for c in cols[1:]:
        total = total + col(c)
    return total / len(cols)


def truncated_days(c) -> Column:
    """Report rule: day text -> number -> whole days toward zero."""
    x = parse_number(c)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def clean_id(c) -> Column:
    """Keep letters and digits only."""
    return F.regexp_replace(col(c).cast("string"), "[^a-zA-Z0-9]", "")


def is_valid_id(c) -> Column:
    return F.coalesce(col(c).cast("string") == clean_id(c), F.lit(False))
