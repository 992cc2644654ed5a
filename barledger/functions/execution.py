"""Fill prices, slippage and commissions as column expressions.

A custom model is any function with the same arguments that returns a column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIXED_BPS = 5.0
VOLUME_BASE_BPS, VOLUME_IMPACT, DEFAULT_ADV = 2.0, 0.1, 1_000_000.0
PER_SHARE, PER_SHARE_MIN, PERCENT = 0.005, 1.0, 0.001


def fixed_slippage(quantity: Column, price: Column, adv: Column | None = None, bps: float = FIXED_BPS) -> Column:
    return F.lit(bps)


def volume_slippage(
    quantity: Column, price: Column, adv: Column | None = None,
    base_bps: float = VOLUME_BASE_BPS, impact: float = VOLUME_IMPACT,
) -> Column:
    """Square-root impact of the traded share of average daily volume, in basis points.

    An unknown or zero volume counts as ``DEFAULT_ADV``.
    """
    volume = F.lit(DEFAULT_ADV) if adv is None else F.coalesce(F.nullif(adv, F.lit(0.0)), F.lit(DEFAULT_ADV))
    return base_bps + impact * F.sqrt(F.abs(quantity * price) / volume) * 100


def fill_price(base: Column, quantity: Column, bps: Column) -> Column:
    """Buys pay up, sells receive less."""
    side = F.when(quantity > 0, 1.0).otherwise(-1.0)
    return base * (1 + side * bps / 10_000)


def fill_base(quantity: Column, close: Column, open_: Column | None = None,
              high: Column | None = None, low: Column | None = None) -> Column:
    """High for buys and low for sells if given, else the open, else the close."""
    choices = []
    if high is not None:
        choices.append(F.when(quantity > 0, high))
    if low is not None:
        choices.append(F.when(quantity < 0, low))
    if open_ is not None:
        choices.append(open_)
    return F.coalesce(*choices, close)


def zero_commission(quantity: Column, price: Column) -> Column:
    return F.lit(0.0)


def per_share_commission(quantity: Column, price: Column, per_share: float = PER_SHARE, minimum: float = PER_SHARE_MIN) -> Column:
    return F.greatest(F.abs(quantity) * per_share, F.lit(minimum))


def percent_commission(quantity: Column, price: Column, share: float = PERCENT) -> Column:
    return F.abs(quantity * price) * share
