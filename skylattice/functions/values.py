"""Cell-value functions: masks, missing values, unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.settings import (CARBON_TO_CO2, GRAVITY, KM_PER_DEG_LAT, KM_PER_DEG_LON_EQUATOR, MOLAR_MASS_AIR,
                                 MOLAR_MASS_CO2, MOLAR_MASS_NO2, SECONDS_PER_YEAR, SENTINEL_FLOOR, Quality)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def missing_if_nan(x) -> Column:
    """NaN and infinities become NULL; every source applies this once."""
    x = _col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def missing_if_sentinel(x, floor: float = SENTINEL_FLOOR) -> Column:
    x = _col(x)
    return F.when(x > floor, x)


def qc_value(df: DataFrame, value="value", cloud="cloud", zenith="sza", qa="qa", q: Quality = Quality()) -> Column:
    """The value where the observation passes quality control, NULL elsewhere; rows are kept."""
    ok = (F.col(cloud) <= q.cloud_max) & (F.col(zenith) <= q.zenith_max)
    if qa in df.columns:
        ok = ok & (F.col(qa) >= q.qa_min)
    return F.when(ok, F.col(value))


def keep_classes(value, scene_class, classes=(4, 5, 6, 7)) -> Column:
    return F.when(_col(scene_class).isin(*classes), _col(value))


def normalised_difference(a, b) -> Column:
    a, b = _col(a), _col(b)
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def safe_ratio(num, den, above: float = 0.0) -> Column:
    """num / den where den > above, NULL elsewhere."""
    return F.when(_col(den) > above, _col(num) / _col(den))


def clip(x, lo, hi) -> Column:
    return F.greatest(_col(lo), F.least(_col(hi), _col(x)))


def kt_per_year(kg_per_s) -> Column:
    return _col(kg_per_s) * F.lit(SECONDS_PER_YEAR / 1e6)


def nox_mass(mol) -> Column:
    return _col(mol) * F.lit(MOLAR_MASS_NO2)


def carbon_as_co2(t_c) -> Column:
    return _col(t_c) * F.lit(CARBON_TO_CO2)


def pixel_km2(lat, res_deg: float) -> Column:
    return F.lit(res_deg * KM_PER_DEG_LAT * res_deg * KM_PER_DEG_LON_EQUATOR) * F.cos(F.radians(_col(lat)))


def column_ppm(kg_m2, surface_pressure_pa) -> Column:
    """CO2 column mass to mole fraction of the air column, ppm."""
    air = _col(surface_pressure_pa) / F.lit(GRAVITY * MOLAR_MASS_AIR)
    return _col(kg_m2) / F.lit(MOLAR_MASS_CO2) / air * F.lit(1e6)


def terrain_normalised(x, elevation_m, scale_height_km: float) -> Column:
    return _col(x) / F.exp(-_col(elevation_m) / F.lit(scale_height_km * 1000.0))


def version_number(text) -> Column:
    """Leading number of a version text ('11.3r' gives 11.3); -1 when there is none."""
    digits = F.rtrim(F.regexp_extract(_col(text), r"^[\d.]+", 0), F.lit("."))
    return F.coalesce(digits.try_cast("double"), F.lit(-1.0))
