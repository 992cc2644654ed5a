"""Ticker notation, wrappers, currencies and compact numbers as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Exchange code -> listing suffix and wrapper label (fixed values).
SUFFIXES = {"LN": ".L", "US": "", "SP": ".SI", "HK": ".HK", "GY": ".DE", "IM": ".MI", "FP": ".PA"}
WRAPPERS = {"LN": "UCITS (LSE)", "US": "US", "SP": "SG", "HK": "HK", "GY": "EU", "IM": "EU", "FP": "EU"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def listing_ticker(code: Column, fund_name: Column) -> Column:
    """``SYM EXCH`` or ``SYM:HK`` to a suffixed ticker; a bare code of a UCITS fund is listed in London."""
    text = F.trim(code)
    words = F.split(text, r"\s+")
    ucits = F.contains(F.upper(F.coalesce(fund_name, F.lit(""))), F.lit("UCITS"))
    bare = F.concat(text, F.when(ucits, ".L").otherwise(""))
    suffixed = F.concat(words[0], F.coalesce(_lookup(SUFFIXES, F.upper(F.get(words, 1))), F.lit("")))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None)).when(F.contains(text, F.lit(":HK")), F.replace(text, F.lit(":HK"), F.lit(".HK")))
        .when(F.size(words) == 1, bare).otherwise(suffixed)
    )


def wrapper_label(code: Column) -> Column:
    text = F.trim(code)
    label = _lookup(WRAPPERS, F.upper(F.get(F.split(text, r"\s+"), 1)))
    return F.when(code.isNull(), "").when(F.contains(text, F.lit(":HK")), "HK").otherwise(F.coalesce(label, F.lit("?")))


def listing_currency(ticker: Column) -> Column:
    return F.when(F.endswith(ticker, F.lit(".SI")), "SGD").when(F.endswith(ticker, F.lit(".HK")), "HKD").otherwise("USD")


def fixed(x: Column, places: int) -> Column:
    """``printf('%.<places>f')`` of doubles from 1 on (from 0 without places), up to three places: the binary value is rounded, half to even.

    ``format_string`` rounds the shortest decimal form half up (1.15 becomes 1.2, though its binary value
    is less), ``format_number`` sets commas. From 1 on a fraction is a whole number of 2**-52, so its
    product with 1,000 fits a long and nothing is lost.
    """
    if places:
        scaled = ((x - F.floor(x)) * 2.0**52).cast("long") * 10**places
        digits = F.shiftright(scaled + (2**51 - 1) + F.shiftright(scaled, 52).bitwiseAND(F.lit(1)), 52)
        exact = (F.floor(x) * 10**places + digits).cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-places))
    else:
        exact = F.rint(x).cast("long")
    return F.when(x < 2.0**52, exact.cast("string")).when(x.isNotNull(), F.format_string(f"%.{places}f", x))


def compact(value: Column, signed: bool = False, precise: bool = False) -> Column:
    """Thousands, millions and billions in short form; a dash for a missing value."""
    size = F.abs(value)
    big, small = (3, 2) if precise else (2, 1)

    def scaled(unit: float, places: int, mark: str) -> Column:
        return F.concat(fixed(size / unit, places), F.lit(mark))

    text = (
        F.when(size >= 1e9, scaled(1e9, big, "B")).when(size >= 1e6, scaled(1e6, big, "M"))
        .when(size >= 1e3, scaled(1e3, small, "K")).otherwise(fixed(size, 0))
    )
    out = F.concat(F.when(value < 0, "-").when((value > 0) & F.lit(signed), "+").otherwise(""), text)
    if signed:
        out = F.when(value == 0, "0").otherwise(out)
    return F.coalesce(out, F.lit("—"))
