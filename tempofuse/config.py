"""Settings of the chain, as frozen dataclasses with a strict JSON form: a key that is not known is an error."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bar:
    """The bar: places of markers and of what is measured, metres from its end. (Fixed values.)"""

    markers: dict[str, float] = field(default_factory=lambda: {"pink_1": 0.20, "pink_2": 0.40, "pink_3": 0.70})
    length: float = 0.838
    sweet: float = 0.686
    hands: float = 0.152
    sensor: float = 0.05

    def __post_init__(self):
        places = list(self.markers.values())
        if len(places) < 2 or len(set(places)) < len(places) or not all(0 <= p <= self.length for p in places):
            raise ValueError("markers need two places or more, all different, on the bar")


@dataclass(frozen=True)
class Sync:
    most_offset: float = 0.15
    refine: float = 0.015


@dataclass(frozen=True)
class Event:
    onset: float = 4.0
    trigger: float = 10.0
    end: float = 4.0
    hold: float = 0.10
    min_gap: float = 1.5
    most: float = 1.2
    pre_roll: float = 1.0
    most_camera_gap: float = 0.06
    guard: float = 0.04


@dataclass(frozen=True)
class Filter:
    gyro_noise: float = 0.02
    bias_walk: float = 0.002
    flex: float = 0.12
    axis: float = 0.03
    gravity: float = 0.6


@dataclass(frozen=True)
class Settings:
    bar: Bar = field(default_factory=Bar)
    sync: Sync = field(default_factory=Sync)
    event: Event = field(default_factory=Event)
    filter: Filter = field(default_factory=Filter)


def from_dict(kind: type, values: dict):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise KeyError(f"{kind.__name__} has no {', '.join(unknown)}")
    parts = {"bar": Bar, "sync": Sync, "event": Event, "filter": Filter}
    return kind(**{k: from_dict(parts[k], v) if kind is Settings else v for k, v in values.items()})


def loads(text: str) -> Settings:
    return from_dict(Settings, json.loads(text))


def dumps(settings: Settings) -> str:
    return json.dumps(dataclasses.asdict(settings), indent=2)
