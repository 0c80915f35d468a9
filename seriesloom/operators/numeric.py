"""Recurrences and transforms that SQL has not: numpy over Arrow batches of whole series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seriesloom.functions.parser import Expr, ParseError, number_text, seconds
from seriesloom.operators.elementwise import wrapped
from seriesloom.operators.pairs import zipped
from seriesloom.plans import frame
from seriesloom.plans.compiler import Context, concatenated
from seriesloom.plans.frame import SeriesList
from seriesloom.plans.registry import function

#: Fixed values of the Holt-Winters method: smoothing factors, season and bootstrap in seconds.
ALPHA, BETA, GAMMA = 0.1, 0.0035, 0.1
SEASON, BOOTSTRAP = 86400, 7 * 86400


@function("ewma", "exponentialWeightedMovingAverage", args="seriesList, alpha", group="Calculate")
def ewma(c: Context, e: Expr) -> SeriesList:
    """The exponentially weighted mean; absent points stay and do not count."""
    alpha = e.number(1, name="alpha")

    def smooth(v: np.ndarray, _) -> np.ndarray:
        out, held = np.full(len(v), np.nan), None
        for i in np.flatnonzero(~np.isnan(v)):
            held = v[i] if held is None else alpha * v[i] + (1 - alpha) * held
            out[i] = held
        return out

    return frame.by_numpy(c.series(e.args[0]), smooth).named(wrapped("ewma", f",{number_text(alpha)}"))


@function("fft", args="seriesList, mode", group="Transform")
def fft(c: Context, e: Expr) -> SeriesList:
    """The Fourier transform's size, its phase, or both; absent points count as 0."""
    mode = e.string(1, "", name="mode")
    s = c.series(e.args[0])
    parts = [("abs", np.abs), ("phase", np.angle)] if mode in ("", "both") else [(mode, {"abs": np.abs, "phase": np.angle}.get(mode))]
    if parts[0][1] is None:
        raise ParseError("mode is abs, phase or both")
    out = [frame.by_numpy(s, lambda v, _, f=f: f(np.fft.fft(np.nan_to_num(v)))).with_(ord=frame.behind(F.col("ord"), k), name=wrapped("fft", f",'{n}'")) for k, (n, f) in enumerate(parts)]
    return out[0] if len(out) == 1 else out[0].having(out[0].df.unionByName(out[1].df))


@function("ifft", args="seriesList, phaseSeriesList", group="Transform")
def ifft(c: Context, e: Expr) -> SeriesList:
    """The size of the inverse Fourier transform, from sizes and, paired by place, phases."""
    s = c.series(e.args[0])
    if len(e.args) < 2:
        return frame.by_numpy(s, lambda v, _: np.abs(np.fft.ifft(np.nan_to_num(v)))).named(wrapped("ifft"))

    def inverse(v: np.ndarray, row: dict) -> np.ndarray:
        return np.abs(np.fft.ifft(np.nan_to_num(v) * np.exp(1j * np.nan_to_num(row["b_values"]))))

    return zipped(s, c.series(e.args[1]), inverse, F.concat(F.lit("ifft("), F.col("name"), F.lit(", "), F.col("b_name"), F.lit(")")), True, "ifft")


@function("polyfit", args="seriesList, degree=1, offset='0d'", group="Calculate")
def polyfit(c: Context, e: Expr) -> SeriesList:
    """The least-squares polynomial over the slots with a value, carried on by an offset."""
    degree, ahead = e.integer(1, 1, name="degree"), e.string(2, "0d", name="offset")
    if degree < 1:
        raise ParseError("degree must be larger or equal to 1")
    more = seconds(ahead, 1)
    tail = (f",{degree}" if len(e.args) > 1 else "") + (f",'{ahead}'" if len(e.args) > 2 else "")

    def fit(v: np.ndarray, row: dict) -> np.ndarray:
        size = len(v) + more // int(row["step"])
        at = np.flatnonzero(~np.isnan(v))
        if len(at) < 2:
            return np.full(size, np.nan)
        scale = max(1, len(v) - 1)  # keeps powers of the slot near 1
        powers = np.vander(at / scale, degree + 1, increasing=True)
        weights, *_ = np.linalg.lstsq(powers, v[at], rcond=None)
        return np.vander(np.arange(size) / scale, degree + 1, increasing=True) @ weights

    return frame.by_numpy(c.series(e.args[0]), fit).with_(name=wrapped("polyfit", tail), stop=F.col("stop") + more)


def holt_winters(v: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and seasonal deviations of triple exponential smoothing with a season of a day."""
    n, season = len(v), SEASON // step
    level, slope = np.full(n, np.nan), 0.0
    seasonal, deviation, predicted = np.zeros(n + 1), np.zeros(n), np.full(n, np.nan)
    coming = np.nan
    for i in range(n):
        predicted[i] = coming
        if np.isnan(v[i]):
            slope, coming = 0.0, np.nan
            continue
        if i == 0:
            predicted[i] = v[i]
        before = level[i - 1] if i and not np.isnan(level[i - 1]) else v[i]
        usual = seasonal[i - season] if i >= season else 0.0
        next_usual = seasonal[i + 1 - season] if i + 1 >= season and i + 1 - season < i else 0.0
        level[i] = ALPHA * (v[i] - usual) + (1 - ALPHA) * (before + slope)
        slope = BETA * (level[i] - before) + (1 - BETA) * slope
        seasonal[i] = GAMMA * (v[i] - level[i]) + (1 - GAMMA) * usual
        spread = deviation[i - season] if i >= season else 0.0
        miss = abs(v[i] - (0.0 if np.isnan(predicted[i]) else predicted[i]))
        deviation[i] = GAMMA * miss + (1 - GAMMA) * spread
        coming = level[i] + slope + next_usual
    return predicted, deviation


def _bootstrapped(c: Context, e: Expr) -> SeriesList:
    return c.shifted(-BOOTSTRAP, 0).series(e.args[0])


def _forecast(c: Context, e: Expr, f, head: str) -> SeriesList:
    """f(values, predictions, deviations) without the bootstrap's slots."""
    start = c.start

    def run(v: np.ndarray, row: dict) -> np.ndarray:
        predicted, deviation = holt_winters(f.read(v), int(row["step"]))
        skip = max(0, -(-(start - int(row["start"])) // int(row["step"])))
        return f(v[skip:], predicted[skip:], deviation[skip:])

    return frame.by_numpy(_bootstrapped(c, e), run).with_(name=wrapped(head), start=F.greatest(F.col("start"), F.lit(start)).cast("long"))


class _Reading:
    """What a forecast makes of values, predictions and deviations, and how it reads absent points."""

    def __init__(self, f, zero: bool):
        self.f, self.zero = f, zero

    def read(self, v: np.ndarray) -> np.ndarray:
        return np.nan_to_num(v) if self.zero else v

    def __call__(self, v, predicted, deviation) -> np.ndarray:
        return self.f(v, predicted, deviation)


@function("holtWintersForecast", args="seriesList, bootstrapInterval='7d'", group="Calculate")
def forecast(c: Context, e: Expr) -> SeriesList:
    """What smoothing over the week before and the range predicts; absent points count as 0."""
    return _forecast(c, e, _Reading(lambda v, p, d: p, True), "holtWintersForecast")


@function("holtWintersConfidenceBands", args="seriesList, delta=3, bootstrapInterval='7d'", group="Calculate")
def confidence_bands(c: Context, e: Expr) -> SeriesList:
    """The prediction less and plus so many deviations."""
    delta = e.number(1, 3.0, name="delta")
    low = _forecast(c, e, _Reading(lambda v, p, d: p - delta * d, False), "holtWintersConfidenceLower")
    high = _forecast(c, e, _Reading(lambda v, p, d: p + delta * d, False), "holtWintersConfidenceUpper")
    return concatenated([low, high])


@function("holtWintersAberration", args="seriesList, delta=3, bootstrapInterval='7d'", group="Calculate")
def aberration(c: Context, e: Expr) -> SeriesList:
    """How far values lie outside the bands, else 0."""
    delta = e.number(1, 3.0, name="delta")

    def outside(v: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
        low, high = p - delta * d, p + delta * d
        out = np.where(v > high, v - high, np.where(v < low, v - low, 0.0))
        return np.where(np.isnan(v) | np.isnan(p), 0.0, out)

    return _forecast(c, e, _Reading(outside, True), "holtWintersAberration")
