"""Whole chains of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import humidity as H
from ..operators import temperature as T
from .result import QCResult

#: The diurnal range comes before the neighbours: an indoor sensor would spoil their means.
TEMPERATURE = {
    1: T.t1_gross_error, 2: T.t2_out_of_range, 3: T.t3_time_consistency, 4: T.t4_stuck_values, 5: T.t5_climatic_outliers,
    8: T.t8_diurnal_range, 6: T.t6_spatial_consistency, 7: T.t7_spatiotemporal_consistency, 9: T.t9_clock_offset, 10: T.t10_interpolate,
}
HUMIDITY = {
    1: H.rh1_inherit_temperature, 2: H.rh2_range, 3: H.rh3_spike, 4: H.rh4_stuck_values, 5: H.rh5_decoupling,
    6: H.rh6_saturation_drift, 7: H.rh7_dewpoint_consistency, 8: H.rh8_interpolate,
}


def pick_levels(levels, n: int, prefix: str) -> list[int]:
    """Level numbers from numbers or names such as ``T3``; negative ones leave levels out."""
    if levels is None:
        return list(range(1, n + 1))
    out = []
    for level in [levels] if isinstance(levels, (int, str)) else list(levels):
        if isinstance(level, str):
            sign = -1 if level.startswith("-") else 1
            name = level.lstrip("-").upper()
            if not name.startswith(prefix) or not name[len(prefix) :].isdigit():
                raise ValueError(f"no level {level!r}")
            level = sign * int(name[len(prefix) :])
        if not isinstance(level, int) or isinstance(level, bool) or level == 0 or abs(level) > n:
            raise ValueError(f"no level {level!r}")
        out.append(level)
    if len({x > 0 for x in out}) > 1:
        raise ValueError("levels are either chosen or left out, not both")
    return sorted(set(out)) if out and out[0] > 0 else [i for i in range(1, n + 1) if -i not in out]


def _run(result: QCResult, chain: dict, levels, given: dict[int, dict], params: dict, prefix: str, interpolate: bool, store: bool) -> QCResult:
    last = max(chain)
    chosen = pick_levels(levels, last, prefix)
    params = {pick_levels(k, last, prefix)[0]: v for k, v in params.items()}
    if unknown := set(params) - set(chain):
        raise ValueError(f"parameters for unknown levels: {unknown}")
    ran, skipped, storing = [], [], result.storing
    result = result.stored(store)  # nine levels of windows are too much for one plan
    for number, level in chain.items():
        if number not in chosen or number == last and not interpolate:
            continue
        # a parameter that is given as None is a value, not an absence
        result = level(result, **{**given.get(number, {}), **params.get(number, {})})
        entry = list(result.info.values())[-1]
        (skipped if entry.get("skipped") else ran).append(f"{prefix}{number}")
    return result.stored(storing).record(f"run_qc_{result.facts.what}", levels=ran, skipped=skipped)


def run_temperature(result: QCResult, metadata: DataFrame | None = None, interpolate: bool = False, levels=None, params: dict | None = None, store: bool = True) -> QCResult:
    """The temperature chain; ``params`` maps a level to its own parameters."""
    return _run(result, TEMPERATURE, levels, {6: {"metadata": metadata}, 7: {"metadata": metadata}}, params or {}, "T", interpolate, store)


def run_humidity(result: QCResult, temperature: QCResult | None = None, metadata: DataFrame | None = None, interpolate: bool = False, levels=None, params: dict | None = None, store: bool = True) -> QCResult:
    """The humidity chain; the temperature result gives flags to the first level and values to others."""
    given = {1: {"temperature": temperature}, 5: {"temperature": temperature}, 7: {"temperature": temperature, "metadata": metadata}}
    return _run(result, HUMIDITY, levels, given, params or {}, "RH", interpolate, store)
