"""Notes on motion metrics: ordered rules, three notes at most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MPH = 2.2369362920544
#: Reference ranges. (Fixed values.)
RANGES = {"speed": (65.0, 80.0), "path_angle": (6.0, 14.0), "bar_angle": (-33.0, -23.0), "time": (0.13, 0.20)}


def notes(speed: Column, peak: Column, path_angle: Column, bar_angle: Column, time: Column, most: int = 3) -> Column:
    """Codes of the notes that apply, in order of rules; a null measure keeps its rules silent; "solid" if none applies."""
    low, high = RANGES["path_angle"]
    rules = [
        F.when(path_angle < low - 5, "path_steep_down").when(path_angle < low, "path_flat").when(path_angle > high + 5, "path_uphill"),
        F.when(time > RANGES["time"][1], "slow_to_contact"),
        F.when(speed < RANGES["speed"][0], F.when(peak - speed > 5, F.lit("early_release")).otherwise(F.lit("low_speed"))),
        F.when(bar_angle > RANGES["bar_angle"][1] + 10, "bar_flat"),
    ]
    said = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return F.when(F.size(said) == 0, F.array(F.lit("solid"))).otherwise(F.slice(said, 1, most))


def signed(value: Column, unit: str = "°") -> Column:
    return F.format_string(f"%+.0f{unit}", value)
