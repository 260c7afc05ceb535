"""All constants of the model in one immutable record, so a scenario is a row and not a patched global."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

HOME_COUNTRY = "United Kingdom"


@dataclass(frozen=True)
class Params:
    # cleaning: lines are stored and few repeat, so only repeated ones are shuffled whole
    mostly_unique: bool = False
    # demand
    n_items: int = 200
    # forecast
    horizon: int = 8
    n_folds: int = 3
    fold_step: int = 8
    min_train: int = 30
    min_nonzero: int = 5
    season_weeks: int = 52
    adi_cutoff: float = 1.32
    cv2_cutoff: float = 0.49
    croston_alpha: float = 0.1
    # replenishment
    service_level: float = 0.95
    review_weeks: int = 1
    # assigned attributes
    seed: int = 42
    home_band_km: tuple[float, float] = (5.0, 120.0)
    export_band_km: tuple[float, float] = (150.0, 300.0)
    # picking and fulfilment
    walk_m_per_s: float = 1.2
    line_handle_s: float = 10.0
    window_weeks: int = 8
    crew: int = 4
    shift_hours: float = 8.0
    carton_cm3: float = 60.0 * 40.0 * 40.0
    carton_kg: float = 20.0
    # delivery
    vehicle_cartons: int = 80
    # rates, GBP
    labour_per_hour: float = 14.50
    transport_per_km: float = 0.85
    holding_per_unit_week: float = 0.02
    facility_per_week: float = 2500.0


class CostRate(NamedTuple):
    """A cost line: the ledger entry it grows with, the price per unit of it, and whether each week is charged."""

    line: str
    grows_with: str
    price: str  # the field of Params that holds it
    weekly: bool = False


COST_RATES = (
    CostRate("labour", "fulfil/labour_hours", "labour_per_hour"),
    CostRate("transport", "transport/savings_km", "transport_per_km"),
    CostRate("holding", "inventory/safety_stock_units", "holding_per_unit_week", weekly=True),
    CostRate("facility", "window/weeks", "facility_per_week"),
)

DEFAULTS = Params()
PENNY = 0.005
FACTORS = (0.80, 0.90, 1.00, 1.10, 1.20)
SERVICE_LEVELS = (0.90, 0.95, 0.99)
SURGE_FACTOR = 1.20
RATE_SHOCK_FACTOR = 1.10
N_DECILES = 10
VARIANTS = ("random", "abc", "optimal")
