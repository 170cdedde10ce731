"""Every time-series feature against its definition in plain Python."""

import cmath
import math
import random
from itertools import groupby

import pytest

from bomloom.functions import features


def mean(x):
    x = list(x)
    return math.fsum(x) / len(x)


def central(x, p):
    m = mean(x)
    return mean((v - m) ** p for v in x)


def quantile(x, q):
    x, at = sorted(x), q * (len(x) - 1)
    low = math.floor(at)
    return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def line(y):
    """(slope, intercept) of least squares over 0, 1, ..."""
    t = range(len(y))
    tm, ym = mean(t), mean(y)
    slope = sum((a - tm) * (b - ym) for a, b in zip(t, y, strict=True)) / sum((a - tm) ** 2 for a in t)
    return slope, ym - slope * tm


def fit(points):
    a, b = zip(*points, strict=True)
    am, bm = mean(a), mean(b)
    return sum((p - am) * (q - bm) for p, q in points) / sum((p - am) ** 2 for p in a)


def acf(x, lag):
    m = mean(x)
    return mean((a - m) * (b - m) for a, b in zip(x[:-lag], x[lag:], strict=True)) / central(x, 2) if lag < len(x) else 0.0


def longest(x, on):
    return max((len(list(run)) for held, run in groupby(map(on, x)) if held), default=0)


def dft(x):
    n = len(x)
    return [sum(v * cmath.exp(-2j * math.pi * k * i / n) for i, v in enumerate(x)) for k in range(n // 2 + 1)]


def shares(p):
    total = sum(p)
    return -sum(v / total * math.log(v / total) for v in p if v > 0)


def entropies(x, lag):
    r = 0.2 * math.sqrt(central(x, 2))

    def matches(m):
        rows = [[x[i + j * lag] for j in range(m)] for i in range(len(x) - (m - 1) * lag)]
        return [sum(all(abs(a - b) <= r for a, b in zip(p, q, strict=True)) for q in rows) for p in rows]

    two, three = matches(2), matches(3)
    a, b = sum(v - 1 for v in three), sum(v - 1 for v in two[: len(three)])
    approximate = mean(math.log(v / len(two)) for v in two) - mean(math.log(v / len(three)) for v in three)
    return approximate, -math.log(a / b) if a and b else 0.0


def walk(x):
    m, out, at = mean(x), [], 0.0
    for v in x:
        at += v - m
        out.append(at)
    return out


def scaling(x, detrended):
    n, steps, points = len(x), walk(x), []
    top = max(4, n // 2)
    for size in sorted({int(4 * (top / 4) ** (i / 7) + 1e-9) for i in range(8)}):
        found = []
        for i in range(0, n - size + 1, size):
            if detrended:
                slope, start = line(steps[i : i + size])
                found.append(mean((v - start - slope * t) ** 2 for t, v in enumerate(steps[i : i + size])))
            elif central(x[i : i + size], 2) > 1e-24:
                inner = walk(x[i : i + size])
                found.append((max(inner) - min(inner)) / math.sqrt(central(x[i : i + size], 2)))
        f = math.sqrt(mean(found)) if detrended else mean(found) if found else 0.0
        if f > 1e-12:
            points.append((math.log(size), math.log(f)))
    return fit(points) if len(points) > 1 else 0.0  # too short a series has no value


def plain(x):
    n, m, v = len(x), mean(x), central(x, 2)
    std, d = math.sqrt(v), [b - a for a, b in zip(x, x[1:], strict=False)]
    second = [(a - 2 * b + c) / 2 for a, b, c in zip(x, x[1:], x[2:], strict=False)]
    slope, start = line(x)
    spectrum = dft(x)
    size, power = [abs(c) for c in spectrum], [abs(c) ** 2 for c in spectrum]
    centre = sum(k * s for k, s in enumerate(size)) / sum(size)
    digits = [int(str(abs(w)).replace("0.", "").lstrip("0")[0]) for w in x if w]
    seen, law = [digits.count(i) / len(digits) for i in range(1, 10)], [math.log10(1 + 1 / i) for i in range(1, 10)]
    lags = [acf(x, i) for i in range(1, min(n, 11))]
    skew, kurt = central(x, 3) / std**3, central(x, 4) / v**2 - 3
    orders = [tuple(sorted(range(3), key=lambda j, i=i: (x[i + j], j))) for i in range(n - 2)]
    width = (max(x) - min(x)) / 10
    bins = [min(9, int((w - min(x)) / width)) for w in x]
    parts, at = [], 0
    for i in range(max(1, n // 8)):
        many = n // max(1, n // 8) + (i < n % max(1, n // 8))
        parts.append(x[at : at + many])
        at += many
    upto, total = [sum(power[: i + 1]) for i in range(len(power))], sum(power)
    f = {
        "mean": m, "median": quantile(x, 0.5), "variance": v, "standard_deviation": std, "linear_trend__slope": slope, "linear_trend__intercept": start, "sum_values": sum(x), "length": n,
        "first_location_of_maximum": x.index(max(x)) / n, "last_location_of_maximum": 1 - x[::-1].index(max(x)) / n,
        "coefficient_variation": std / m, "skewness": skew, "kurtosis": kurt, "range_count": sum(m - std <= w <= m + std for w in x), "ratio_beyond_r_sigma__r_1": mean(abs(w - m) > std for w in x),
        "approximate_entropy": entropies(x, 1)[0], "sample_entropy": entropies(x, 1)[1], "approximate_entropy__lag_2": entropies(x, 2)[0], "sample_entropy__lag_2": entropies(x, 2)[1],
        "benford_correlation": mean((a - mean(seen)) * (b - mean(law)) for a, b in zip(seen, law, strict=True)) / math.sqrt(central(seen, 2) * central(law, 2)),
        "fft_aggregated__aggtype_mean": centre, "fft_aggregated__aggtype_variance": sum(k * k * s for k, s in enumerate(size)) / sum(size) - centre**2,
        "quantile__q_0_1": quantile(x, 0.1), "quantile__q_0_25": quantile(x, 0.25), "quantile__q_0_75": quantile(x, 0.75), "quantile__q_0_9": quantile(x, 0.9), "iqr": quantile(x, 0.75) - quantile(x, 0.25),
        "minimum": min(x), "maximum": max(x), "absolute_maximum": max(map(abs, x)), "range": max(x) - min(x), "absolute_energy": sum(w * w for w in x),
        "autocorr_strength": mean(map(abs, lags)), "autocorr_tendency": mean(lags),
        "number_peaks": sum(a < b > c for a, b, c in zip(x, x[1:], x[2:], strict=False)), "number_valleys": sum(a > b < c for a, b, c in zip(x, x[1:], x[2:], strict=False)),
        "longest_strike_above_mean": longest(x, lambda w: w > m), "longest_strike_below_mean": longest(x, lambda w: w < m), "longest_strike_above_zero": longest(x, lambda w: w > 0), "longest_strike_below_zero": longest(x, lambda w: w < 0),
        "number_crossing_m": sum((a > m) != (b > m) for a, b in zip(x, x[1:], strict=False)), "number_crossing_0": sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False)),
        "permutation_entropy": shares([orders.count(o) for o in set(orders)]), "spectral_entropy": shares(power), "shannon_entropy": shares([bins.count(b) for b in range(10)]),
        "complexity_invariant": math.sqrt(sum(w * w for w in d)), "hurst_exponent": scaling(x, False), "detrended_fluctuation_analysis": scaling(x, True),
        "fft_power": total / n, "fft_centroid": sum(k * p for k, p in enumerate(power)) / total, "fft_magnitude_ratio": max(size[1:]) / sum(size),
        "welch_power_spectral_density": mean(mean(abs(c) ** 2 for c in dft([w - mean(p) for w in p])) / len(p) for p in parts),
        "spectral_rolloff": next(i for i, p in enumerate(upto) if p >= 0.85 * total) / len(power), "spectral_centroid_freq": centre / n,
        "mean_abs_change": mean(map(abs, d)), "mean_second_derivative": mean(second), "trend_strength": 1 - sum((w - start - slope * t) ** 2 for t, w in enumerate(x)) / (n * v), "mean_abs_change_rate": mean(map(abs, d)) / abs(m),
        "sum_of_absolute_second_derivative": sum(map(abs, second)), "mean_absolute_second_derivative": mean(map(abs, second)), "count_above_mean": sum(w > m for w in x), "count_below_mean": sum(w < m for w in x),
        "skewness_lag_1": central(d, 3) / central(d, 2) ** 1.5, "kurtosis_lag_1": central(d, 4) / central(d, 2) ** 2 - 3, "moment_3": central(x, 3), "moment_4": central(x, 4),
        "fisher_skewness": skew * math.sqrt(n * (n - 1)) / (n - 2), "fisher_kurtosis": ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)), "raw_moment_3": mean(w**3 for w in x), "raw_moment_4": mean(w**4 for w in x),
    }
    f |= {f"autocorrelation__lag_{i}": acf(x, i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 12, 14, 24, 28)}
    for i in range(5):
        c = spectrum[i] if i < len(spectrum) else 0j
        f |= {f"fft_coefficient__attr_real__coeff_{i}": c.real, f"fft_coefficient__attr_imag__coeff_{i}": c.imag}
    return f


@pytest.mark.parametrize("n, seed", [(9, 1), (30, 2), (61, 3), (128, 4)])
def test_every_feature(n, seed):
    draw = random.Random(seed)
    x = [draw.choice([1, -1, 1]) * draw.randint(1, 50) + draw.choice([0.0, 0.5]) for _ in range(n)]
    want, got = plain(x), dict(zip(features.NAMES, features.features(features.np.array(x)).tolist(), strict=True))
    assert set(want) == set(got) and len(want) == 92
    wrong = {k: (got[k], want[k]) for k in want if not math.isclose(got[k], want[k], rel_tol=1e-7, abs_tol=1e-7)}
    assert not wrong
