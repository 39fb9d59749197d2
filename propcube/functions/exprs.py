"""Column-expression helpers shared by all operators.

Everything here returns a ``Column`` built from Spark SQL built-ins, so it
stays inside whole-stage codegen; there are no Python UDFs.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube import schemas as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _idiv(a: Column, b: Column) -> Column:
    """Exact integral division (SQL ``a div b``), result BIGINT."""
    return F.call_function("div", a, b)


def exact_round_div(num: Column, den: Column) -> Column:
    """round(num / den, 0) half away from zero, exact on integers.

    ``num`` is an integral decimal(38,0), ``den`` a positive integer; the
    result is BIGINT. ``den`` = 0 gives NULL (no rows in the group), never an
    error under ANSI mode.
    """
    den = F.nullif(den, F.lit(0))
    q = _idiv(F.abs(num) * 2 + den, den * 2)
    return F.when(num < 0, -q).otherwise(q)


def exact_avg(c: str | Column, in_scale: int = 2, out_scale: int = 2,
              out_type: T.DecimalType = S.MONEY) -> Column:
    """``ROUND(AVG(c), out_scale)`` computed exactly (aggregate Column).

    ``c`` is an exact decimal with ``in_scale`` fraction digits. The sum is
    taken over integer units in decimal(38,0) and divided once with
    half-away-from-zero rounding, so there is no double rounding and no
    floating point. Nulls are ignored; an empty group yields NULL.
    """
    assert out_scale <= in_scale
    x = col(c)
    units = F.sum((x * F.lit(10 ** in_scale)).cast("decimal(38,0)"))
    den = F.count(x) * F.lit(10 ** (in_scale - out_scale))
    q = exact_round_div(units, den)
    return scaled(q, out_scale, out_type)


def exact_sum(c: str | Column, out_type: T.DecimalType = S.MONEY) -> Column:
    """SUM of an exact decimal, cast to the declared output type."""
    return F.sum(col(c)).cast(out_type)


def scaled(q: Column, scale: int, out_type: T.DataType) -> Column:
    """Integer ``q`` in units of 10^-scale -> decimal, without division."""
    step = F.lit(Decimal(1).scaleb(-scale)) if scale else F.lit(Decimal(1))
    return (q.cast("decimal(38,0)") * step).cast(out_type)


def exact_mean_of(sum_units: Column, n: Column, scale: int,
                  out_type: T.DataType) -> Column:
    """Rounded mean from an integer sum (in 10^-scale units) and a count."""
    return scaled(exact_round_div(sum_units, n), scale, out_type)


def units(c: str | Column, scale: int) -> Column:
    """Exact integer count of 10^-scale units held by a decimal value."""
    return (col(c) * F.lit(10 ** scale)).cast("decimal(38,0)")


def contains_ci(c: str | Column, term: str) -> Column:
    """SQL ``c ILIKE '%term%'``: user ``%``/``_`` stay wildcards."""
    return col(c).ilike(f"%{term}%")


def all_of(preds: list[Column]) -> Column:
    """Conjunction of the supplied predicates (TRUE when none)."""
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def hash_u32(*parts: str | Column) -> Column:
    """Deterministic 32-bit integer from md5 of the key parts.

    ``conv(substr(md5(k),1,8),16,10)`` equals DuckDB's
    ``('0x'||substr(md5(k),1,8))::BIGINT``, which keeps the synthetic
    columns oracle-checkable.
    """
    key = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


# -- formatting (dashboard helpers) -----------------------------------------

def indian_group(int_str: Column) -> Column:
    """Insert Indian digit-group separators: 1234567 -> 12,34,567."""
    return F.regexp_replace(int_str, r"(\d)(?=(\d\d)*\d{3}$)", "$1,")


def format_number(c: str | Column, decimals: int = 0) -> Column:
    """Indian-grouped number rounded half-up to ``decimals`` digits.

    Trailing fraction zeros are dropped (at most ``decimals`` digits), like
    an ``en-IN`` locale number format. NULL -> '—'.
    """
    x = F.round(col(c).cast("decimal(38,6)"), decimals)
    neg = x < 0
    ax = F.abs(x)
    ip = F.floor(ax).cast("decimal(38,0)").cast("string")
    grouped = indian_group(ip)
    if decimals:
        frac_units = ((ax - F.floor(ax)) * F.lit(10 ** decimals)).cast("bigint")
        frac = F.regexp_replace(F.lpad(frac_units.cast("string"), decimals, "0"), "0+$", "")
        body = F.when(frac == "", grouped).otherwise(F.concat(grouped, F.lit("."), frac))
    else:
        body = grouped
    body = F.when(neg, F.concat(F.lit("-"), body)).otherwise(body)
    return F.when(col(c).isNull(), F.lit("—")).otherwise(body)


def format_price(c: str | Column) -> Column:
    """Rupee label: >=1 crore 'x.xx Cr', >=1 lakh 'x.xx L', else grouped.

    NULL or 0 -> '—'. Decimal half-up rounding of the exact value.
    """
    x = col(c).cast("decimal(20,2)")
    cr = F.round(x * F.lit(Decimal("0.0000001")), 2).cast("decimal(20,2)").cast("string")
    lk = F.round(x * F.lit(Decimal("0.00001")), 2).cast("decimal(20,2)").cast("string")
    return (F.when(x.isNull() | (x == 0), F.lit("—"))
            .when(x >= 10 ** 7, F.concat(F.lit("₹"), cr, F.lit(" Cr")))
            .when(x >= 10 ** 5, F.concat(F.lit("₹"), lk, F.lit(" L")))
            .otherwise(F.concat(F.lit("₹"), format_number(x, 3))))


def transact_label(c: str | Column) -> Column:
    return F.when(col(c) == 2, F.lit(S.TRANSACT_LABELS[2])).otherwise(F.lit(S.TRANSACT_LABELS[1]))


def furnish_label(c: str | Column) -> Column:
    m = F.create_map(*[x for k, v in S.FURNISH_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, col(c).cast("int")), F.lit("—"))


def bhk_label(c: str | Column) -> Column:
    return F.concat(col(c).cast("string"), F.lit(" BHK"))


def date_label(c: str | Column) -> Column:
    """'05 Oct 2022'; NULL -> '—'."""
    return F.coalesce(F.date_format(col(c), "dd MMM yyyy"), F.lit("—"))


def clamp_text(c: str | Column, n: int) -> Column:
    """First ``n`` characters; empty -> NULL."""
    return F.nullif(F.substring(col(c), 1, n), F.lit(""))
