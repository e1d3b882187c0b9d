"""Scalar expressions whose edge cases decide results.

Three notions of "missing" are kept apart: exact (NULL or the empty string), trimmed
(NULL or white space only) and the training loader's (NULL or the empty string after
a CSV read, where both mean an empty cell).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Text that Python's float() accepts, but for signed nan, once stripped. Nothing that a part has taken is given back.
_DIGITS = r"\d++(?:_\d++)*+"
FLOAT_GRAMMAR = rf"(?i)^[+-]?+(?:(?:{_DIGITS}\.?+(?:{_DIGITS})?+|\.{_DIGITS})(?:e[+-]?+{_DIGITS})?+|inf|infinity|nan)$"
#: White space of regular expressions.
WHITE = " \t\n\x0b\f\r"


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.btrim(col(c).cast("string"), F.lit(WHITE))


def py_float(c: str | Column) -> Column:
    """The number that Python's float() reads from a text, NULL where it would fail.

    Spark's own cast takes ``1d`` and refuses ``1_000``; neither is wanted here.
    """
    text = strip(c)
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    signed_nan = F.lower(text).isin("+nan", "-nan")
    return F.when(signed_nan, F.lit(float("nan"))).when(text.rlike(FLOAT_GRAMMAR), number)


def is_number(c: str | Column) -> Column:
    """Whether py_float reads a number; never NULL. One regular expression a cell."""
    return F.coalesce(strip(c).rlike(FLOAT_GRAMMAR), F.lit(False))


def number(df: DataFrame, c: str) -> Column:
    """A column as a number: numeric types as they are, anything else read by py_float."""
    kind = df.schema[c].dataType
    return col(c).cast("double") if isinstance(kind, NumericType) else py_float(c)


def missing_exact(c: str | Column) -> Column:
    return col(c).isNull() | (col(c).cast("string") == "")


def missing_trimmed(c: str | Column) -> Column:
    return col(c).isNull() | (strip(c) == "")


def missing_in_csv(c: str | Column) -> Column:
    return missing_exact(c)


def parse_date(c: str | Column, fmt: str = "%d-%b-%y", iso: bool = True) -> Column:
    """A date from ISO text or else from ``fmt``; NULL where neither fits.

    Two-digit years pivot at 69 as in strptime: 69 to 99 are of the last century.
    """
    text = strip(c)
    pattern, two_digits = java_format(fmt)
    read = F.to_date(F.try_to_timestamp(text, F.lit(pattern)))
    if two_digits:
        read = F.when(F.year(read) >= 2069, F.add_months(read, -1200)).otherwise(read)
    if not iso:
        return read
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")), read)


def java_format(fmt: str) -> tuple[str, bool]:
    """(Spark's pattern for a strptime format, whether the year has two digits)."""
    table = {"%d": "d", "%b": "MMM", "%B": "MMMM", "%m": "M", "%y": "yy", "%Y": "yyyy", "%H": "H", "%M": "m", "%S": "s"}
    out = fmt
    for a, b in table.items():
        out = out.replace(a, b)
    return out, "%y" in fmt


def log1p_of(c: str) -> Column:
    """log(1 + max(v, 0)); NULL where the cell is no number."""
    v = py_float(c)
    return F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0))))


def ratio(numerator: str, denominator: str, eps: float = 1e-6) -> Column:
    a, b = py_float(numerator), py_float(denominator) + F.lit(eps)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(b != 0, a / b).otherwise(F.lit(0.0)))


def difference(a: str, b: str) -> Column:
    return py_float(a) - py_float(b)


def engineered(spec) -> list[Column]:
    """The derived features of an ``Engineered`` block as named columns."""
    return [
        *(log1p_of(c).alias(f"log1p_{c}") for c in spec.log1p),
        *(ratio(a, b, spec.eps).alias(name) for name, a, b in spec.ratios),
        *(difference(a, b).alias(name) for name, a, b in spec.differences),
    ]


def scalar_target(c: str | Column, fill: float = 0.0) -> Column:
    """The target as a number; missing, unreadable and non-finite cells get ``fill``."""
    v = py_float(c)
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(fine, v).otherwise(F.lit(float(fill)))


def all_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def encode_row(columns: list[str]) -> Column:
    """A row as a JSON document; a map keeps NULL cells, a struct would drop them."""
    pairs = [x for c in columns for x in (F.lit(c), col(c).cast("string"))]
    return F.to_json(F.create_map(*pairs))


def decode_row(c: str | Column) -> Column:
    return F.from_json(col(c), "map<string,string>")
