"""Expressions shared by the cleaning steps; all stay inside generated code."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .types import ref

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020"
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts read as missing when a file is loaded.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def null_if_token(col: Column, tokens=NULL_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def to_double(col: Column, dtype: T.DataType) -> Column:
    """Number or NULL. Text must look like a plain decimal number: a bare cast
    would also take forms such as ``5d``."""
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(_NUMBER), col.try_cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return F.lit(None).cast("double")


def to_whole(col: Column, dtype: T.DataType) -> Column:
    """Whole number or NULL; fractional input gives NULL, never a rounded value."""
    if isinstance(dtype, T.IntegralType):
        return col.cast("bigint")
    number = to_double(col, dtype)
    whole = F.when(F.floor(number).cast("double") == number, number.try_cast("bigint"))
    if isinstance(dtype, T.StringType):
        # Digits beyond 2^53 survive only when read as a whole number first.
        return F.coalesce(F.when(col.rlike(_NUMBER), col.try_cast("bigint")), whole)
    return whole


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL."""
    floats = [
        f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({c: F.when(~F.isnan(ref(c)), ref(c)) for c in floats})


def any_of(conditions) -> Column:
    """Balanced OR, so that wide tables do not build a deep expression tree."""
    conditions = list(conditions)
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [
            conditions[i] | conditions[i + 1] if i + 1 < len(conditions) else conditions[i]
            for i in range(0, len(conditions), 2)
        ]
    return conditions[0]


def total_of(parts) -> Column:
    parts = list(parts)
    if not parts:
        return F.lit(0)
    while len(parts) > 1:
        parts = [
            parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]


def significant(col: Column, digits: int) -> Column:
    """A number's text with so many significant digits and no closing zeros; beyond that
    many places before the point, or more than four zeros behind it, with an exponent.
    NULL stays NULL."""
    parts = F.split(F.format_string(f"%.{digits - 1}e", F.abs(col.cast("double"))), "e")
    mantissa, exponent = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    figures, power = F.regexp_replace(mantissa, r"\.", ""), exponent.try_cast("int")
    whole = F.concat(F.substring(figures, F.lit(1), power + 1), F.lit("."), F.substring(figures, power + 2, F.lit(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    plain = F.regexp_replace(F.when(power >= 0, whole).otherwise(small), r"\.?0*$", "")
    short = F.concat(F.regexp_replace(mantissa, r"\.?0*$", ""), F.lit("e"), exponent)
    text = F.when((power >= digits) | (power < -4), short).when(col == 0, "0").otherwise(plain)
    signed = F.concat(F.when(col < 0, "-").otherwise(""), text)
    endless = F.when(F.isnan(col), "nan").when(F.abs(col) == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
    return F.coalesce(endless, F.when(col.isNotNull(), signed))
