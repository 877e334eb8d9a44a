"""Derived ventilation and gas-exchange variables, prediction intervals and small numeric helpers, as Columns."""

from __future__ import annotations

import json
import math
import os
import re
from fractions import Fraction
from hashlib import md5, sha256

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(a: Column, b: Column) -> Column:
    """a / b, null unless b is above 0."""
    return F.when(b > 0, a / b)


def rsbi(rr: Column, tv_ml: Column) -> Column:
    return guarded(rr, tv_ml / 1000.0)


def sf_ratio(spo2: Column, fio2_fraction: Column) -> Column:
    return guarded(spo2, fio2_fraction)


def safi(spo2: Column, fio2_percent: Column) -> Column:
    """SpO2 over the fraction of inspired oxygen, within [0, 1000]."""
    return F.greatest(F.least(guarded(spo2, fio2_percent / 100.0), F.lit(1000.0)), F.lit(0.0))


def driving_pressure(pip: Column, peep: Column) -> Column:
    return pip - peep


def compliance(tv_ml: Column, pip: Column, peep: Column) -> Column:
    return guarded(tv_ml, pip - peep)


def minute_volume(mv: Column, tv_ml: Column, rr: Column) -> Column:
    return F.coalesce(mv, tv_ml * rr / 1000.0)


def mechanical_power(rr: Column, tv_ml: Column, pip: Column, peep: Column) -> Column:
    return 0.098 * rr * (tv_ml / 1000.0) * (pip - (pip - peep) / 2)


def ventilatory_ratio(rr: Column, etco2: Column, percent: bool = False) -> Column:
    return rr * (etco2 * 7.6 if percent else etco2) / 400.0


def oxygenation_index(map_airway: Column, fio2_percent: Column, pao2: Column) -> Column:
    return guarded(map_airway * fio2_percent, pao2)


def scaled(value: Column, median: float) -> Column:
    """value over a reference median, 0 where it is missing."""
    return F.coalesce(value / median, F.lit(0.0))


def missing_mask(value: Column) -> Column:
    return value.isNull().cast("double")


#: Normal quantiles of 80 and 90 percent intervals.
Z80, Z90 = 1.28155, 1.64485


def lognormal_predictions(mu: Column, sigma: Column) -> list[Column]:
    spread = lambda z: F.exp(mu + z * sigma)
    return [F.exp(mu).alias("median"), F.exp(mu + sigma * sigma / 2).alias("mean"), spread(-Z80).alias("lo80"), spread(Z80).alias("hi80"), spread(-Z90).alias("lo90"), spread(Z90).alias("hi90")]


def lognormal_nll(target_log: Column, mu: Column, log_sigma: Column) -> Column:
    return log_sigma + (target_log - mu) * (target_log - mu) / (2 * F.exp(2 * log_sigma)) + 0.5 * math.log(2 * math.pi)


def format_duration(seconds: Column) -> Column:
    """1d 2h 3m; leading zero parts are left out."""
    minutes = F.floor(seconds / 60)
    d, h, m = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60
    part = lambda n, unit, shown: F.when(shown, F.concat(n.cast("string"), F.lit(unit)))
    return F.concat_ws(" ", part(d, "d", d > 0), part(h, "h", (d > 0) | (h > 0)), part(m, "m", F.lit(True)))


def name_timestamp(name: Column) -> Column:
    """The time in `token_yymmdd_HHMMSS`, null for other names."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"_(\d{6}_\d{6})(?:\.\w+)?$", 1), F.lit("")), F.lit("yyMMdd_HHmmss"))


def numeric_or(value: Column, otherwise: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(otherwise))


def above_sentinel(value: Column, floor: float = -32000.0) -> Column:
    return F.when(value >= floor, value)


# ---- driver-side helpers


def expand_env(text: str) -> str:
    """${NAME} and ${NAME:-default} by the environment; an unset name without default stays as it is."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1]) or (m[2] if m[2] is not None else m[0]), text)


def config_hash(config: dict, length: int = 8) -> str:
    return sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:length]


def cache_key(config: dict) -> str:
    return md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]


def dataset_version(config: dict, version: str = "1") -> str:
    return f"v{version}_{config_hash(config)}"


def up_down(native: float, target: float, cap: int = 1000) -> tuple[int, int]:
    """Factors of a rational resampling, no larger than cap."""
    ratio = Fraction(target).limit_denominator(10**6) / Fraction(native).limit_denominator(10**6)
    near = ratio.limit_denominator(cap)
    if max(near.numerator, near.denominator) > cap or abs(float(near / ratio) - 1) > 1e-3:
        raise ValueError(f"no ratio near {target}/{native} within {cap}")
    return near.numerator, near.denominator
