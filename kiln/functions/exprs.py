"""Column-expression helpers shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that pandas.read_csv treats as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fixed value: the category that stands for a missing categorical cell.
MISSING_CATEGORY = "vacio"

# Whitespace as Python's str.strip sees it (ASCII subset that matters for CSV text).
_WS = "[\\s\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f\\x85\\xa0]"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: removes leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def is_blank(c: Column) -> Column:
    """``^\\s*$`` on text."""
    return c.rlike("^\\s*$")


# Text that becomes all digits after dropping the first '.' (str.isdigit on ASCII digits).
NUMERIC_TEXT = "^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$"
INTEGER_TEXT = "^[0-9]{1,18}$"


def micros(c: Column) -> Column:
    """Microseconds since epoch of a timestamp / timestamp_ntz column (UTC session)."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros_ntz(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def portable_hash(cols: Sequence[Column], seed: int = 42) -> Column:
    """MD5 (hexadecimal) of a seed and the values of ``cols`` of any type, the same in DuckDB:
    ``md5(concat_ws(chr(31), seed, c1, c2, ...))`` with NULL as empty text."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def r6(c: Column) -> Column:
    """Round to 6 decimals: float sums differ in the last bits between engines."""
    return F.round(c.cast("double"), 6)


def numeric_columns(df: DataFrame, cols=None) -> list[str]:
    names = cols if cols is not None else df.columns
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in names if isinstance(types[c], T.NumericType)]


def string_columns(df: DataFrame, cols=None) -> list[str]:
    names = cols if cols is not None else df.columns
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in names if isinstance(types[c], T.StringType)]


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def q(name: str) -> Column:
    """Column by exact name (back-ticked, so dots and spaces are safe)."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def inv_norm(p: Column) -> Column:
    """Inverse standard normal CDF (Acklam's rational approximation, |err| < 1.2e-9)."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    plow = 0.02425

    def poly(coef, x):
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out

    ql = F.sqrt(-2 * F.log(p))
    low = poly(c, ql) / (poly(d, ql) * ql + 1)
    qc = p - 0.5
    r = qc * qc
    central = poly(a, r) * qc / (poly(b, r) * r + 1)
    qh = F.sqrt(-2 * F.log(1 - p))
    high = -poly(c, qh) / (poly(d, qh) * qh + 1)
    return F.when(p < plow, low).when(p <= 1 - plow, central).otherwise(high)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function (rational approximation, error below 8e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)
