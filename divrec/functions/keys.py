"""Canonical keys: text of conditioning values, reproducible random buckets and fractions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_text(df: DataFrame, name: str) -> Column:
    """A value as it stands in a key: whole numbers without decimals, missing as ``NA``; different values have different texts.

    A floating number has the shortest text that gives it back, without an
    exponent where 38 digits, 19 of them decimals, suffice. The text depends on
    the value alone, never on other values, so a value can't fall into two
    subsets, nor two values into one.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d, short = c.cast("double"), c.cast("string")
        plain = short.try_cast("decimal(38,19)")
        plain = F.when(plain.cast("string").try_cast(kind) == c, _no_zeros(plain.cast("string")))
        whole = F.when(F.abs(d) < 9e18, F.floor(d).cast("string")).otherwise(short.try_cast("decimal(38,0)").cast("string"))
        whole = F.when(d % 1.0 == 0, whole)
        inf = F.when(d > 0, "Inf").otherwise("-Inf")
        c = F.when(F.isnan(d), None).when(F.abs(d) == float("inf"), inf).when(d == 0, "0").otherwise(F.coalesce(whole, plain, short))
    elif isinstance(kind, T.DecimalType):
        c = _no_zeros(c.cast("string"))
    elif isinstance(kind, T.BooleanType):
        c = F.upper(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("NA"))


def _no_zeros(number: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def escaped(text: Column, names: Sequence[str]) -> Column:
    """A value that looks as if the next variable began in it (``|b=``) gets a backslash there, so that no two combinations share a key.

    Backslashes before such a place, or at the value's end, are doubled; all
    other values stand as they are.
    """
    if len(names) < 2:
        return text
    next_one = "|".join(re.escape(n) for n in names)
    marked = F.regexp_replace(F.regexp_replace(text, rf"(\\*)\|(?=(?:{next_one})=)", r"$1$1\\|"), r"(?<!\\)(\\+)$", "$1$1")
    return F.when(F.contains(text, F.lit("|")) | F.endswith(text, F.lit("\\")), marked).otherwise(text)  # patterns only where needed


def condition_key(df: DataFrame, names: Sequence[str]) -> Column:
    """``a=1|b=x`` over the conditioning columns."""
    text = lambda n: escaped(value_text(df, n), names) if isinstance(df.schema[n].dataType, T.StringType) else value_text(df, n)
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), text(n)) for n in names])


def md5_number(text: Column, seed: int | str = "") -> Column:
    """0 .. 2**32 - 1 from the md5 of ``seed:text``: the same under any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 8), 16, 10).cast("bigint")


def bucket(text: Column, n: int, seed: int | str = "") -> Column:
    """1..n."""
    return md5_number(text, seed) % F.lit(n) + 1


def fraction(text: Column, seed: int | str = "") -> Column:
    """A number in 0..1 (1 excluded)."""
    return md5_number(text, seed) / F.lit(float(1 << 32))


def row_identity(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """Text of the given (else all) columns of a row, NULLs included."""
    cols = list(names or df.columns)
    return F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string") if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(F.struct(f"`{c}`")), F.lit("NA")) for c in cols])
