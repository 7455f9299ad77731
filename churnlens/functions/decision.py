"""Column expressions of the expected-value decision layer (K1-K3).

A contact reaches a customer who accepts with probability a. Accepting keeps what the customer would
have brought over the horizon H, worth mc * H * margin with probability p, and costs the discount,
mc * H * discount, for sure. With the cost of the contact itself:

    VE(p) = gain * p - cost,   gain = a * mc * H * margin,   cost = a * mc * H * discount + contact

so the threshold, where VE is 0, is cost / gain, and its floor, without the contact, is discount /
margin. Assumptions are literals or, for a sensitivity grid, columns: the same expressions serve both.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the assumptions' defaults, and the one-at-a-time sensitivity grid (31 points)
DEFAULTS = {"margin": 0.30, "discount": 0.10, "acceptance": 0.40, "horizon": 12, "contact_cost": 15.0}
DEFAULT_GRID: dict[str, list[float]] = {
    "margin": [0.15, 0.20, 0.25, 0.30, 0.40, 0.50],
    "discount": [0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30],
    "acceptance": [0.10, 0.20, 0.30, 0.40, 0.60, 0.80],
    "horizon": [3, 6, 12, 18, 24, 36],
    "contact_cost": [0.0, 5.0, 15.0, 30.0, 50.0, 100.0],
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class BusinessParams:
    """Assumptions about the business; none is learned from data."""

    margin: float = DEFAULTS["margin"]
    discount: float = DEFAULTS["discount"]
    acceptance: float = DEFAULTS["acceptance"]
    horizon: int = DEFAULTS["horizon"]
    contact_cost: float = DEFAULTS["contact_cost"]

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


PARAM_NAMES = list(DEFAULTS)


def param_cols(params: BusinessParams | dict | None = None) -> dict[str, Column]:
    """The assumptions as columns; a dict may hold columns already."""
    given = params if isinstance(params, dict) else (params or BusinessParams()).as_dict()
    return {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in given.items()}


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gain_and_cost(mc: Column | str, params: BusinessParams | dict | None = None) -> tuple[Column, Column]:
    """What a contact brings per unit of churn probability, and what it costs whatever the probability."""
    a = param_cols(params)
    billed = a["acceptance"] * _column(mc) * a["horizon"]
    return billed * a["margin"], billed * a["discount"] + a["contact_cost"]


def expected_value(p: Column | str, mc: Column | str, params: BusinessParams | dict | None = None) -> Column:
    """K1: expected value of contacting one customer."""
    gain, cost = gain_and_cost(mc, params)
    return gain * _column(p) - cost


def threshold_floor(params: BusinessParams | dict | None = None) -> Column:
    """K2: below this probability no contact ever pays, however cheap."""
    a = param_cols(params)
    return F.try_divide(a["discount"], a["margin"])


def customer_threshold(mc: Column | str, params: BusinessParams | dict | None = None) -> Column:
    """K3: the probability from which contacting this customer pays; null if a contact can bring nothing."""
    gain, cost = gain_and_cost(mc, params)
    return F.try_divide(cost, gain)
