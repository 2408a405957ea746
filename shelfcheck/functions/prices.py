"""Price arithmetic and price text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcheck.constants import COUNTRIES, DISPLAY_RATES, WHOLE_UNIT_COUNTRIES
from shelfcheck.functions.text import col, filled, num, strip


def fmt(c: Column, digits: int) -> Column:
    """Grouped decimal text, ties to even."""
    return F.format_number(c, digits)


def rate_of(country: str | None) -> float:
    return COUNTRIES[country][2] if country in COUNTRIES else 1.0


def symbol_of(country: str | None) -> str:
    return COUNTRIES[country][1] if country in COUNTRIES else "$"


def local_price(sale: Column | str, price: Column | str, country: str | None,
                rate: float | None = None) -> Column:
    """Sale price (else price) in local currency; '' when missing or not positive."""
    usd = num(F.coalesce(F.nullif(strip(col(sale).cast("string")), F.lit("")), col(price).cast("string")))
    usd_rate = rate if rate is not None else DISPLAY_RATES.get(country, 1.0)
    digits = 0 if country in WHOLE_UNIT_COUNTRIES else 2
    text = F.concat(F.lit(symbol_of(country) + " "), fmt(usd * F.lit(float(usd_rate)), digits))
    return F.coalesce(F.when(usd > 0, text), F.lit(""))


def parse_price(c: Column | str) -> Column:
    """Digits and dots of a price text as a number text; '' when not positive."""
    value = num(F.regexp_replace(col(c).cast("string"), r"[^\d.]", ""))
    return F.coalesce(F.when(value > 0, value.cast("string")), F.lit(""))


def derive_discount(discount: Column | str, old: Column | str, sale: Column | str) -> Column:
    """Stated discount, or the computed whole percentage when it is missing."""
    o, s = num(old), num(sale)
    computed = F.concat(
        F.bround((o - s) / F.nullif(o, F.lit(0.0)) * 100, 0).cast("long").cast("string"), F.lit("%")
    )
    return F.coalesce(
        filled(discount, ("nan", "None")), F.when((o > 0) & (s < o), computed), F.lit("")
    )
