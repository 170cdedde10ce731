"""92 features of a series of quantities, after the definitions of the tsfresh paper and documentation.

Where those leave a choice: moments are those of the population; a feature that has no
value (too short a series, no variance) is 0; entropies use natural logarithms.
"""

from __future__ import annotations

import math

import numpy as np

# Feature names by category, in the order of their indices from 0.
CATALOGUE: list[tuple[str, str]] = [
    ("consumption", "mean median variance standard_deviation linear_trend__slope linear_trend__intercept sum_values length first_location_of_maximum last_location_of_maximum"),
    ("volatility", "coefficient_variation skewness kurtosis range_count ratio_beyond_r_sigma__r_1 approximate_entropy sample_entropy benford_correlation"),
    ("frequency", "fft_coefficient__attr_real__coeff_0 fft_coefficient__attr_imag__coeff_0 fft_coefficient__attr_real__coeff_1 fft_coefficient__attr_imag__coeff_1 fft_coefficient__attr_real__coeff_2 fft_coefficient__attr_imag__coeff_2 fft_aggregated__aggtype_mean fft_aggregated__aggtype_variance"),
    ("temporal", "autocorrelation__lag_1 autocorrelation__lag_7 autocorrelation__lag_14 autocorrelation__lag_28"),
    ("quantile", "quantile__q_0_1 quantile__q_0_25 quantile__q_0_75 quantile__q_0_9 iqr"),
    ("extremes", "minimum maximum absolute_maximum range absolute_energy"),
    ("temporal", "autocorrelation__lag_2 autocorrelation__lag_3 autocorrelation__lag_4 autocorrelation__lag_5 autocorrelation__lag_6 autocorrelation__lag_8 autocorrelation__lag_12 autocorrelation__lag_24 autocorr_strength autocorr_tendency"),
    ("peaks", "number_peaks number_valleys longest_strike_above_mean longest_strike_below_mean longest_strike_above_zero longest_strike_below_zero number_crossing_m number_crossing_0"),
    ("entropy", "permutation_entropy spectral_entropy shannon_entropy approximate_entropy__lag_2 sample_entropy__lag_2 complexity_invariant hurst_exponent detrended_fluctuation_analysis"),
    ("frequency", "fft_coefficient__attr_real__coeff_3 fft_coefficient__attr_imag__coeff_3 fft_coefficient__attr_real__coeff_4 fft_coefficient__attr_imag__coeff_4 fft_power fft_centroid fft_magnitude_ratio welch_power_spectral_density spectral_rolloff spectral_centroid_freq"),
    ("trend", "mean_abs_change mean_second_derivative trend_strength mean_abs_change_rate sum_of_absolute_second_derivative mean_absolute_second_derivative count_above_mean count_below_mean"),
    ("statistics", "skewness_lag_1 kurtosis_lag_1 moment_3 moment_4 fisher_skewness fisher_kurtosis raw_moment_3 raw_moment_4"),
]
NAMES = [n for _, names in CATALOGUE for n in names.split()]
CATEGORIES = [c for c, names in CATALOGUE for _ in names.split()]
DOMAIN = ["receipt_ratio", "reversal_ratio", "weekend_ratio", "weekday_concentration", "trend_strength", "growth"]
#: Pairs of places that the entropies, which compare all pairs, hold at once.
_PAIRS = 1 << 20


def _moments(x: np.ndarray) -> tuple[float, float]:
    d = x - x.mean()
    s = math.sqrt((d**2).mean())
    return ((d**3).mean() / s**3, (d**4).mean() / s**4 - 3) if s > 1e-12 else (0.0, 0.0)


def _power_sum(values: list[float], p: int) -> float:
    total = 0.0
    try:
        for v in values:
            total += v**p
    except OverflowError:
        return math.inf
    return total


def _in_order(x: np.ndarray) -> tuple[float, ...]:
    """(mean, variance, slope, start, third, fourth central moment), summed in the order of the series, one value after the other.

    The last bits are then those of an aggregate that reads the series row by row, and a
    value halfway between two decimals is rounded to the same side.
    """
    values, total = x.tolist(), 0.0
    at, level, both, places, square = 0.0, 0.0, 0.0, 0.0, 0.0  # means, and sums of products of differences from them
    for n, v in enumerate(values, 1):
        ahead, off = n - 1 - at, v - level
        at, level, total = at + ahead / n, level + off / n, total + v
        both, places, square = both + ahead * (v - level), places + ahead * (n - 1 - at), square + off * (v - level)
    mean, slope = total / n, (both / n) / (places / n) if n > 1 else 0.0
    differences = [v - mean for v in values]
    return mean, square / n, slope, mean - slope * ((n - 1) / 2), _power_sum(differences, 3) / n, _power_sum(differences, 4) / n


def _autocorrelation(d: np.ndarray, v: float, lag: int) -> float:
    """Of a series by its differences from the mean and its variance."""
    return float((d[:-lag] * d[lag:]).mean() / v) if lag < len(d) and v > 1e-12 else 0.0


def _longest(on: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _matches(x: np.ndarray, m: int, r: float, lag: int = 1) -> np.ndarray:
    """For each template of m places, lag apart, with how many templates (itself included) it agrees."""
    n = len(x) - (m - 1) * lag
    if n < 1:
        return np.zeros(0)
    order = np.argsort(x[:n], kind="stable")
    y = np.stack([x[j * lag : j * lag + n][order] for j in range(m)])
    reach, step = r + 1e-9 * (r + np.abs(x).max()), max(1, _PAIRS // n)  # a little further, against rounding
    out = np.zeros(n)
    for i in range(0, n, step):
        own = y[:, i : i + step]
        a, b = np.searchsorted(y[0], own[0, 0] - reach), np.searchsorted(y[0], own[0, -1] + reach, "right")
        near = np.ones((own.shape[1], b - a), bool)
        for p, q in zip(own, y[:, a:b], strict=True):
            near &= np.abs(p[:, None] - q) <= r
        out[order[i : i + step]] = near.sum(1)
    return out


def _entropies(x: np.ndarray, lag: int = 1) -> tuple[float, float]:
    """(approximate, sample) entropy with templates of 2 and a tolerance of a fifth of the deviation."""
    r = 0.2 * x.std()
    two, three = _matches(x, 2, r, lag), _matches(x, 3, r, lag)
    if r <= 1e-12 or not len(three):
        return 0.0, 0.0
    a, b = (three - 1).sum(), (two[: len(three)] - 1).sum()
    return float(np.log(two / len(two)).mean() - np.log(three / len(three)).mean()), float(-math.log(a / b)) if a > 0 and b > 0 else 0.0


def _shares(p: np.ndarray) -> float:
    p = p[p > 0] / max(p.sum(), 1e-300)
    return float(-(p * np.log(p)).sum())


def _scaling(x: np.ndarray, detrended: bool) -> float:
    """The slope of log fluctuation over log window: of ranges (Hurst), or of residuals from lines (DFA)."""
    n, walk = len(x), np.cumsum(x - x.mean())
    points = []
    for size in np.unique(np.geomspace(4, max(4, n // 2), 8).astype(int)):
        parts = n // size
        if not parts:
            continue
        rows = (walk if detrended else x)[: parts * size].reshape(parts, size)
        rows = rows - rows.mean(1, keepdims=True)
        if detrended:
            t = np.arange(size) - (size - 1) / 2
            f = math.sqrt(np.mean((rows - (rows @ t / (t @ t))[:, None] * t) ** 2))
        else:
            spread = np.sqrt((rows**2).mean(1))
            ratios = np.ptp(np.cumsum(rows, 1), 1)[spread > 1e-12] / spread[spread > 1e-12]
            f = float(np.mean(ratios)) if len(ratios) else 0.0
        if f > 1e-12:
            points.append((math.log(size), math.log(f)))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) > 1 else 0.0


def features(x: np.ndarray) -> np.ndarray:
    """The features of a series, in the order of NAMES."""
    n = len(x)
    mean, square, slope, start, third, fourth = _in_order(x)
    std, d, t = math.sqrt(square), np.diff(x), np.arange(n)
    skew, kurt = _moments(x)
    spectrum = np.fft.rfft(x)
    size, power = np.abs(spectrum), np.abs(spectrum) ** 2
    k = np.arange(len(size))
    fft = [(float(spectrum[i].real), float(spectrum[i].imag)) if i < len(spectrum) else (0.0, 0.0) for i in range(5)]
    centre = float((k * size).sum() / size.sum()) if size.sum() > 1e-12 else 0.0
    spread = float((k**2 * size).sum() / size.sum() - centre**2) if size.sum() > 1e-12 else 0.0
    digits = np.array([int(f"{v:e}"[0]) for v in np.abs(x) if v > 0])
    benford = 0.0
    if len(digits):
        seen = np.bincount(digits, minlength=10)[1:10] / len(digits)
        benford = float(np.corrcoef(seen, np.log10(1 + 1 / np.arange(1, 10)))[0, 1]) if seen.std() > 0 else 0.0
    (apen, sampen), (apen2, sampen2) = _entropies(x), _entropies(x, 2)
    q = np.quantile(x, [0.1, 0.25, 0.75, 0.9])
    off = x - mean
    lags = {lag: _autocorrelation(off, square, lag) for lag in (*range(1, 13), 14, 24, 28)}
    acf = np.array([lags[lag] for lag in range(1, min(n, 11))])
    inner = x[1:-1]
    above, crossing = x > mean, lambda on: int((on[1:] != on[:-1]).sum())
    orders = np.unique(np.argsort(np.lib.stride_tricks.sliding_window_view(x, 3), axis=1, kind="stable"), axis=0, return_counts=True)[1] if n > 2 else np.zeros(1)
    second = (x[2:] - 2 * inner + x[:-2]) / 2 if n > 2 else np.zeros(1)
    ends = np.flatnonzero(np.cumsum(power) >= 0.85 * power.sum())
    dskew, dkurt = _moments(d) if n > 2 else (0.0, 0.0)
    fit = 1 - ((x - (start + slope * t)) ** 2).sum() / ((x - mean) ** 2).sum() if std > 1e-12 else 0.0
    change = np.abs(d).mean() if n > 1 else 0.0
    values = [
        *(mean, np.median(x), square, std, slope, start, x.sum(), n, np.argmax(x) / n, 1 - np.argmax(x[::-1]) / n),
        *(std / mean if abs(mean) > 1e-12 else 0.0, skew, kurt, ((x >= mean - std) & (x <= mean + std)).sum(), (np.abs(x - mean) > std).mean(), apen, sampen, benford),
        *(v for c in fft[:3] for v in c), centre, spread,
        *(lags[i] for i in (1, 7, 14, 28)),
        *q, q[2] - q[1],
        *(x.min(), x.max(), np.abs(x).max(), np.ptp(x), (x**2).sum()),
        *(lags[i] for i in (2, 3, 4, 5, 6, 8, 12, 24)), np.abs(acf).mean() if len(acf) else 0.0, acf.mean() if len(acf) else 0.0,
        *(((inner > x[:-2]) & (inner > x[2:])).sum(), ((inner < x[:-2]) & (inner < x[2:])).sum(), _longest(above), _longest(x < mean), _longest(x > 0), _longest(x < 0), crossing(above), crossing(x > 0)),
        *(_shares(orders.astype(float)), _shares(power), _shares(np.histogram(x, 10)[0].astype(float)), apen2, sampen2, math.sqrt((d**2).sum()), _scaling(x, False) if n > 7 else 0.0, _scaling(x, True) if n > 7 else 0.0),
        *(v for c in fft[3:] for v in c), power.sum() / n, (k * power).sum() / power.sum() if power.sum() > 1e-12 else 0.0, size[1:].max(initial=0.0) / size.sum() if size.sum() > 1e-12 else 0.0,
        *(np.mean([np.mean(np.abs(np.fft.rfft(p - p.mean())) ** 2) / len(p) for p in np.array_split(x, max(1, n // 8))]), ends[0] / len(power) if len(ends) else 0.0, centre / n),
        *(change, second.mean(), fit, change / abs(mean) if abs(mean) > 1e-12 else 0.0, np.abs(second).sum(), np.abs(second).mean(), above.sum(), (x < mean).sum()),
        *(dskew, dkurt, third, fourth, skew * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else 0.0, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)) if n > 3 else 0.0, (x**3).mean(), (x**4).mean()),
    ]
    return np.nan_to_num(np.array(values, float), nan=0.0, posinf=0.0, neginf=0.0)
