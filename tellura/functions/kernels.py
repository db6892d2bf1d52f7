"""NumPy kernels of signal processing, from their published definitions; no Spark here."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from tellura.errors import ParameterError

# --- filter design: analogue prototypes, bilinear transform, second-order sections


def _butterworth_poles(order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def _chebyshev_poles(order: int, ripple_db: float) -> np.ndarray:
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu = math.asinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    return -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)


def _to_sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Rows (b0, b1, b2, 1, a1, a2); pole pairs nearest the unit circle come last, each with its nearest zeros."""

    def pairs(roots: np.ndarray) -> list[np.ndarray]:
        up = sorted(roots[roots.imag > 1e-10], key=lambda r: abs(1 - abs(r)))
        real = sorted(roots[np.abs(roots.imag) <= 1e-10].real)
        out = [np.array([r, np.conj(r)]) for r in up]
        while real:
            out.append(np.array([real.pop(), *([real.pop(0)] if real else [])]))
        return out

    free = pairs(zeros)
    rows = []
    for p in sorted(pairs(poles), key=lambda p: -np.abs(p).max()):
        same = [z for z in free if len(z) == len(p)] or free
        z = min(same, key=lambda z: abs(z[0] - p[0])) if same else np.array([])
        free = [x for x in free if x is not z]
        b, a = np.poly(z).real if len(z) else np.array([1.0]), np.poly(p).real
        rows.append([*np.pad(b, (0, 3 - len(b))), *np.pad(a, (0, 3 - len(a)))])
    rows.reverse()
    sections = np.array(rows)
    sections[0, :3] *= gain
    return sections


def design(poles: np.ndarray, kind: str, edges: list[float], fs: float, gain: float = 1.0) -> np.ndarray:
    """Sections of a digital filter from low-pass prototype ``poles`` of edge 1 rad/s."""
    warped = [2 * math.tan(math.pi * e / fs) for e in edges]  # bilinear transform at 2 samples a second
    n = len(poles)
    if kind == "lowpass":
        p, z, k = poles * warped[0], np.array([], complex), gain * warped[0] ** n
    elif kind == "highpass":
        p, z, k = warped[0] / poles, np.zeros(n, complex), gain / np.prod(-poles).real
    else:
        width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = poles * width / 2 if kind == "bandpass" else width / 2 / poles
        root = np.sqrt(half**2 - centre**2 + 0j)
        p = np.concatenate([half + root, half - root])
        if kind == "bandpass":
            z, k = np.zeros(n, complex), gain * width**n
        else:
            z, k = np.concatenate([np.full(n, 1j * centre), np.full(n, -1j * centre)]), gain / np.prod(-poles).real
    dp, dz = (2 + p) / (2 - p), (2 + z) / (2 - z)
    k = k * (np.prod(2 - z) / np.prod(2 - p)).real
    return _to_sections(np.concatenate([dz, np.full(len(dp) - len(dz), -1.0 + 0j)]), dp, k)


def butterworth(order: int, kind: str, edges: list[float], fs: float) -> np.ndarray:
    return design(_butterworth_poles(order), kind, edges, fs, float(np.prod(-_butterworth_poles(order)).real))


def chebyshev1(order: int, ripple_db: float, edge: float, fs: float) -> np.ndarray:
    poles = _chebyshev_poles(order, ripple_db)
    gain = np.prod(-poles).real / (math.sqrt(10 ** (ripple_db / 10)) if order % 2 == 0 else 1)
    return design(poles, "lowpass", [edge], fs, float(gain))


def response(sections: np.ndarray, freqs: np.ndarray, fs: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(freqs) / fs)
    out = np.ones(len(z), complex)
    for b0, b1, b2, a0, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z**2) / (a0 + a1 * z + a2 * z**2)
    return out


def ring(sections: np.ndarray, rest: float = 1e-14) -> int:
    """Samples after which the slowest pole of the sections has died away to ``rest``."""
    radius = max(np.abs(np.roots(s[3:])).max(initial=0.0) for s in sections)
    return math.ceil(math.log(rest) / math.log(min(max(radius, 1e-3), 1 - 1e-12)))


def _steady(section: np.ndarray) -> np.ndarray:
    """State of a section after a long input of ones (transposed direct form II)."""
    b0, b1, b2, _, a1, a2 = section
    y = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([y - b0, b2 - a2 * y])


def _section_filter(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section by blocks: within a block the recursion is a matrix product, between blocks its two-number state goes on."""
    b0, b1, b2, _, a1, a2 = section
    size = 64
    # responses of a block to the state and to an impulse
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(powers[-1] @ step)
    by_state = np.array([m[0] for m in powers[:size]])
    drive = np.array([b1 - a1 * b0, b2 - a2 * b0])
    impulse = np.concatenate([[b0], [(powers[i] @ drive)[0] for i in range(size - 1)]])
    mix = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(size)] for i in range(size)])
    to_state = np.stack([powers[size - 1 - j] @ drive for j in range(size)], axis=1)
    pad = -len(x) % size
    blocks = np.concatenate([x, np.zeros(pad)]).reshape(-1, size)
    y, inject, carry = blocks @ mix.T, blocks @ to_state.T, powers[size]
    states = np.empty((len(blocks), 2))
    for i in range(len(blocks)):
        states[i] = state
        state = carry @ state + inject[i]
    return (y + states @ by_state.T).ravel()[: len(x)]


def sections_filter(sections: np.ndarray, x: np.ndarray, steady: bool = False) -> np.ndarray:
    """Causal filtering; with ``steady`` as if ``x[0]`` had come before for ever."""
    scale, y = x[0] if len(x) else 0.0, np.asarray(x, np.float64)
    for s in sections:
        y = _section_filter(s, y, _steady(s) * scale if steady else np.zeros(2))
        scale *= (s[0] + s[1] + s[2]) / (1 + s[4] + s[5])
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards over an odd extension of the ends, which takes out the phase."""
    x = np.asarray(x, np.float64)
    taps = 2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
    edge = int(min(3 * taps, len(x) - 1))
    if len(x) < 2:
        return x.copy()
    left, right = 2 * x[0] - x[edge:0:-1], 2 * x[-1] - x[-2 : -edge - 2 : -1]
    y = sections_filter(sections, np.concatenate([left, x, right]), True)
    y = sections_filter(sections, y[::-1], True)[::-1]
    return y[edge : len(y) - edge] if edge else y


def decimate_step(x: np.ndarray, q: int) -> np.ndarray:
    """Chebyshev low-pass of order 8 at 0.8 of the new nyquist, zero phase, then every q-th sample."""
    return zero_phase(chebyshev1(8, 0.05, 0.8 / q, 2.0), x)[::q]


def fill_gaps(sample: np.ndarray, value: np.ndarray, unknown: str = "no value") -> np.ndarray:
    """Values with NaN on the line between the known neighbours, beyond the ends that of the nearest; samples ascend. Without any the error ``unknown``."""
    known, gaps = np.flatnonzero(~np.isnan(value)), np.flatnonzero(np.isnan(value))
    if not len(known):
        raise ParameterError(unknown)
    at = np.searchsorted(known, gaps)
    left, right = known[np.maximum(at - 1, 0)], known[np.minimum(at, len(known) - 1)]
    with np.errstate(invalid="ignore"):
        line = value[left] + (value[right] - value[left]) * (sample[gaps] - sample[left]) / np.maximum(sample[right] - sample[left], 1)
    out = value.copy()
    out[gaps] = np.where(left == right, value[left], line)
    return out


# --- resampling ------------------------------------------------------------


def resample_ratio(fs: float, new_fs: float) -> tuple[int, int]:
    ratio = Fraction(new_fs / fs).limit_denominator()
    return ratio.numerator, ratio.denominator


def resample_taps(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass at the lower nyquist, Hamming window, gain ``up``."""
    wide = max(up, down)
    half = 10 * wide
    at = np.arange(-half, half + 1)
    h = np.sinc(at / wide) / wide * (0.54 + 0.46 * np.cos(np.pi * at / half))
    return h / h.sum() * up


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase FIR resampling; ends are padded with the mean. Gives ceil(n * up / down) samples."""
    x = np.asarray(x, np.float64)
    if up == down:
        return x.copy()
    mean, h = x.mean(), resample_taps(up, down)
    half, n = len(h) // 2, -(-len(x) * up // down)
    # y[m] = sum_k h[m * down - k * up + half] * x[k], a phase of outputs at a time
    width = len(h) // up + 1
    padded = np.concatenate([np.zeros(width), x - mean, np.zeros(width + 1)])
    y = np.empty(n)
    for phase in range(min(up, n)):
        m = np.arange(phase, n, up)
        last = (m * down + half) // up  # the newest sample with a tap
        first_tap = m[0] * down + half - last[0] * up
        taps = h[first_tap::up]
        spots = last[:, None] - np.arange(len(taps)) + width
        y[m] = np.where((spots >= 0) & (spots < len(padded)), padded[np.clip(spots, 0, len(padded) - 1)], 0.0) @ taps
    return y + mean


# --- tapers and transforms -------------------------------------------------


def next_fast_len(n: int) -> int:
    """Least number from ``n`` on whose only prime factors are 2, 3 and 5."""
    best = 1 << max(0, (n - 1).bit_length())
    fives = 1
    while fives < best:
        threes = fives
        while threes < best:
            twos = threes << max(0, math.ceil(math.log2(n / threes)) if threes < n else 0)
            if twos >= n:
                best = min(best, twos)
            threes *= 3
        fives *= 5
    return best


def dpss(n: int, bandwidth: float = 5.0) -> np.ndarray:
    """First discrete prolate spheroidal sequence, by its tridiagonal eigenproblem; peak 1 or nearly so."""
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * bandwidth / n)
    off = i[1:] * (n - i[1:]) / 2
    w = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))[1][:, -1]
    w = np.abs(w) / np.abs(w).max()
    return w if n % 2 else w * n**2 / (n**2 + bandwidth)  # an even length misses the peak


def _cosine_sum(*a: float):
    return lambda m: sum((-1) ** k * c * np.cos(2 * np.pi * k * np.arange(m) / (m - 1)) for k, c in enumerate(a)) if m > 1 else np.ones(1)


TAPERS = {
    "boxcar": np.ones, "hann": np.hanning, "hanning": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "bartlett": np.bartlett,
    "nuttall": _cosine_sum(0.3635819, 0.4891775, 0.1365995, 0.0106411), "blackmanharris": _cosine_sum(0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": _cosine_sum(0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368), "cosine": lambda m: np.sin(np.pi / m * (np.arange(m) + 0.5)),
    "triang": lambda m: 1 - np.abs((np.arange(m) - (m - 1) / 2) / ((m + m % 2) / 2)), "parzen": lambda m: _parzen(m),
}
PARAMETRIC = {
    "kaiser": lambda m, beta: np.kaiser(m, beta), "gaussian": lambda m, std: np.exp(-0.5 * ((np.arange(m) - (m - 1) / 2) / std) ** 2),
    "tukey": lambda m, alpha: _tukey(m, alpha), "exponential": lambda m, tau: np.exp(-np.abs(np.arange(m) - (m - 1) / 2) / tau),
    "general_hamming": lambda m, a: a - (1 - a) * np.cos(2 * np.pi * np.arange(m) / (m - 1)),
}


def _parzen(m: int) -> np.ndarray:
    x = np.abs(np.arange(m) - (m - 1) / 2) / (m / 2)
    return np.where(x <= 0.5, 1 - 6 * x**2 * (1 - x), 2 * (1 - x) ** 3)


def _tukey(m: int, alpha: float) -> np.ndarray:
    if alpha <= 0:
        return np.ones(m)
    x = np.minimum(np.arange(m), m - 1 - np.arange(m)) / (min(alpha, 1.0) * (m - 1) / 2)
    return np.where(x < 1, 0.5 * (1 - np.cos(np.pi * np.minimum(x, 1))), 1.0)


def taper(name: str | tuple | float | None, n: int) -> np.ndarray:
    """Periodic window of ``n`` samples by name, (name, parameter) or Kaiser beta; ``dpss`` is symmetric."""
    if name is None:
        return np.ones(n)
    if name == "dpss":
        return dpss(n, 5)
    if isinstance(name, (int, float)):
        name = ("kaiser", float(name))
    if isinstance(name, str):
        if name not in TAPERS:
            raise ParameterError(f"unknown window {name!r}")
        return np.asarray(TAPERS[name](n + 1), np.float64)[:-1]
    kind, *values = name
    if kind == "dpss":
        return dpss(n, *values)
    if kind in TAPERS and not values:
        return taper(kind, n)
    if kind not in PARAMETRIC:
        raise ParameterError(f"unknown window {kind!r}")
    return np.asarray(PARAMETRIC[kind](n + 1, *values), np.float64)[:-1]


def detrend(x: np.ndarray, kind: str | None) -> np.ndarray:
    """Rows less their mean or least-squares line."""
    if kind is None:
        return x
    if kind == "constant":
        return x - x.mean(axis=-1, keepdims=True)
    if kind != "linear":
        raise ParameterError(f"unknown detrend {kind!r}")
    p = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    slope = (x * p).sum(axis=-1, keepdims=True) / max((p * p).sum(), 1e-300)
    return x - x.mean(axis=-1, keepdims=True) - slope * p


def spectrum(x: np.ndarray, window: np.ndarray, kind: str | None, n: int) -> np.ndarray:
    """Unitary real FFT of tapered rows, padded with zeros to ``n``."""
    return np.fft.rfft(detrend(np.asarray(x, np.float64), kind) * window, n=n, axis=-1, norm="ortho")


# --- smoothing, interpolation, down-sampling -------------------------------


def _smooth(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean along rows; beyond an end the row is mirrored, the end repeated."""
    h = len(weights) // 2
    n = x.shape[-1]
    at = np.arange(-h, n + h) % (2 * n)
    at = np.where(at < n, at, 2 * n - 1 - at)
    wide = x[..., at]
    return sum(w * wide[..., i : i + n] for i, w in enumerate(weights))


def uniform_width(proportion: float, n: int) -> int:
    """Odd length of the uniform filter for ``n`` frequencies."""
    width = int(proportion * n)
    return max(1, width + 1 - width % 2)


def smooth_uniform(x: np.ndarray, width: int) -> np.ndarray:
    return _smooth(x, np.full(width, 1 / width))


def gaussian_weights(sigma: float) -> np.ndarray:
    h = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    return w / w.sum()


def smooth_gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    return _smooth(x, gaussian_weights(sigma))


def lttb(x: np.ndarray, y: np.ndarray, n_out: int) -> np.ndarray:
    """Positions kept by largest-triangle-three-buckets: of each bucket the point that spans most with the one before and the next bucket's mean."""
    n = len(x)
    if n_out >= n or n <= 2:
        return np.arange(n)
    if n_out < 3:
        raise ParameterError("down-sampling keeps three points at least")
    edges = bucket_edges(n, n_out)
    kept = [0]
    for i in range(n_out - 2):
        here = np.arange(edges[i], edges[i + 1])
        ahead = slice(edges[i + 1], edges[i + 2]) if i + 2 < len(edges) else slice(n - 1, n)
        cx, cy = x[ahead].mean(), y[ahead].mean()
        a = kept[-1]
        area = np.abs((x[a] - cx) * (y[here] - y[a]) - (x[a] - x[here]) * (cy - y[a]))
        kept.append(int(here[np.argmax(area)]))
    return np.array([*kept, n - 1])


def bucket_edges(n: int, n_out: int) -> np.ndarray:
    """Positions where the buckets of lttb() begin; the last is that of the last point."""
    return np.linspace(1, n - 1, n_out - 1).astype(int)


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the convex hull's corners among points in order of ``x``: a point on or inside a chord of its neighbours can't be one."""

    def upper(v: np.ndarray) -> np.ndarray:
        at = np.arange(len(x))
        while len(at) > 2:
            a, b, c = at[:-2], at[1:-1], at[2:]
            out = (v[b] - v[a]) * (x[c] - x[a]) > (v[c] - v[a]) * (x[b] - x[a])
            if out.all():
                break
            at = np.concatenate([at[:1], b[out], at[-1:]])
        return at

    return np.union1d(upper(y), upper(-y)) if len(x) else np.empty(0, np.int64)


def lttb_of_hulls(first: tuple[float, float], buckets: list[tuple[np.ndarray, np.ndarray, float, float]], last: tuple[float, float]) -> list[float]:
    """lttb() from the buckets' corners and means (x, y, mean x, mean y): the triangle's area is linear in its third point, so a corner has the largest."""
    ax, ay = first
    kept = [ax]
    for i, (x, y, _, _) in enumerate(buckets):
        cx, cy = buckets[i + 1][2:] if i + 1 < len(buckets) else last
        best = int(np.argmax(np.abs((ax - cx) * (y - ay) - (ax - x) * (cy - ay))))
        ax, ay = float(x[best]), float(y[best])
        kept.append(ax)
    return [*kept, last[0]]
