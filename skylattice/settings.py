"""Study settings: every threshold the operators use by default.

All of them are plain keyword defaults; pass other values to the operators to change them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Physical and geometric constants that results depend on.
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON_EQUATOR = 111.320
SECONDS_PER_YEAR = 31_557_600.0
MOLAR_MASS_NO2 = 0.0460055
MOLAR_MASS_CO = 0.0280101
MOLAR_MASS_CO2 = 0.0440095
MOLAR_MASS_AIR = 0.0289644
GRAVITY = 9.80665
CARBON_TO_CO2 = 44.0095 / 12.011
EARTH_RADIUS_M = 6_371_000.0
SENTINEL_FLOOR = -9998.0


@dataclass(frozen=True)
class Quality:
    """QC thresholds for one product."""

    cloud_max: float = 0.3
    zenith_max: float = 70.0
    qa_min: float = 0.7
    min_valid_fraction: float = 0.5
    fence_k: float = 3.0
    fence_window_px: int = 7


@dataclass(frozen=True)
class WindFrame:
    """Wind-aligned bins of the rotated composite and the regimes that enter it."""

    along_lo: float = -40.0
    along_hi: float = 60.0
    across_half: float = 20.0
    step: float = 2.0
    fit_along_max: float = 45.0
    calm_max: float = 2.0
    windy_min: float = 2.0
    windy_max: float = 8.0
    upwind: tuple[float, float] = (-40.0, -20.0)
    downwind: tuple[float, float] = (20.0, 40.0)

    @property
    def n_along(self) -> int:
        return round((self.along_hi - self.along_lo) / self.step)

    @property
    def n_across(self) -> int:
        return round(2 * self.across_half / self.step)

    @property
    def width_m(self) -> float:
        return 2 * self.across_half * 1000.0


@dataclass(frozen=True)
class GridSpec:
    """Regular lat/lon pixel grid, rows numbered north to south."""

    lat_top: float
    lon_left: float
    res: float
    n_rows: int
    n_cols: int

    @property
    def lat_mid(self) -> float:
        return self.lat_top - self.res * (self.n_rows - 1) / 2


@dataclass(frozen=True)
class Study:
    season_months: tuple[int, ...] = (10, 11, 12, 1, 2, 3, 4, 5)
    quality: Quality = field(default_factory=Quality)
    frame: WindFrame = field(default_factory=WindFrame)
    nox_no2_ratio: float = 1.32
    scale_height_km: float = 8.4
    corridor_buffer_km: float = 3.5
    cluster_radius_km: float = 5.0
    source_search_km: float = 15.0
    k_folds: int = 5
    seed: int = 42
    min_block_km: int = 5
    variogram_max_km: float = 30.0
    holdout_buffer_km: float = 5.0


STUDY = Study()

# Feature groups of the cell-by-season model table.
GEOGRAPHY = ("dist_to_source_km", "x_utm", "y_utm")
WEATHER = ("ws850", "wd850_sin", "wd850_cos", "blh_m", "frac_ese", "t2m_k", "ssrd_j_m2", "hcho")
ACTIVITY = ("viirs_rad", "ndvi", "ndbi", "road_major_km", "road_mid_km", "road_minor_km",
            "road_total_km", "industrial_frac")
FEATURE_SETS = {
    "A": ("no2",),
    "B": ("no2", "co_norm"),
    "C": ("no2", "co_norm", *WEATHER),
    "D": ("no2", "co_norm", *WEATHER, *ACTIVITY),
    "N0": GEOGRAPHY,
}
# Which inputs each label is built from.
CONSTRUCTION_LINKS = {
    "label_fd": ("no2", "ws850", "wd850", "frac_ese"),
    "label_co": ("co_norm", "ws850", "wd850", "frac_ese"),
}
