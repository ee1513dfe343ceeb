"""Site and resolution settings.

Fixed values: they come with the survey programme and must be exactly these
for results to agree with earlier products.
"""

from __future__ import annotations

from dataclasses import dataclass

# site -> (first transect, last transect)
MOP_RANGES = {
    "DelMar": (595, 620),
    "Solana": (637, 666),
    "Encinitas": (708, 764),
    "SanElijo": (683, 708),
    "Torrey": (567, 581),
    "Blacks": (520, 567),
}

# site -> grid height in metres; sites that are not listed use DEFAULT_HEIGHT
GRID_HEIGHTS = {"DelMar": 30.0, "SanElijo": 40.0, "Solana": 50.0, "Encinitas": 50.0, "Torrey": 75.0, "Blacks": 100.0}
DEFAULT_HEIGHT = 30.0

# instrument label -> name fragments; the first rule that matches wins
SENSOR_RULES = (
    ("MiniRanger", ("ATV", "MiniRanger")),
    ("VZ2000", ("VMZ2000",)),
    ("VMQLZ", ("VMQLZ",)),
)

CLUSTER_EPS = 0.35
CLUSTER_MIN_SAMPLES = 30
MIN_CHANGE = 0.25
MIN_CHANGE_BY_SITE = {"Torrey": 0.30}
THIN_RADIUS = 0.05
CROP_BUFFER = 500.0
QC_MIN_POINTS = 1000
NOISE_VOLUME = 0.005
LARGE_VOLUME = 5.0
POWER_LAW_CUTOFF = 0.25
MIN_FILL_VOLUME = 2.0
NO_CUTOFF = 9999.0
WINTER_MONTHS = (1, 2, 3, 10, 11, 12)


@dataclass(frozen=True)
class Resolution:
    """Grid resolution with its cleaning and filling parameters."""

    name: str
    file_tag: str
    size: float
    min_cells: int
    buffer_bins: int
    alpha: float
    buffer: float

    @property
    def area(self) -> float:
        return self.size * self.size


RESOLUTIONS = {
    r.name: r
    for r in (
        Resolution("10cm", "10cm", 0.10, 25, 20, 0.10, 0.2),
        Resolution("25cm", "25cm", 0.25, 4, 8, 0.04, 0.5),
        Resolution("1m", "100cm", 1.00, 1, 2, 0.01, 2.0),
    )
}


def grid_height(location: str) -> float:
    return GRID_HEIGHTS.get(location, DEFAULT_HEIGHT)


def min_change(location: str) -> float:
    return MIN_CHANGE_BY_SITE.get(location, MIN_CHANGE)


def bin_count(height: float, res: float) -> int:
    return round(height / res)
