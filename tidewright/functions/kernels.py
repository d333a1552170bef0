"""Numerical kernels of one bounded series (no SciPy): spectra, peaks, envelopes and band-pass filters.

They run inside grouped pandas functions, on series that were downsampled or
cut to a bounded length before.
"""

from __future__ import annotations

import numpy as np


def cleaned(x) -> np.ndarray:
    """Non-finite samples become the median of the others; zeros if there is none."""
    x = np.asarray(x, np.float64).ravel()
    ok = np.isfinite(x)
    return np.where(ok, x, np.median(x[ok]) if ok.any() else 0.0)


def welch(x: np.ndarray, rate: float, length: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density: periodic Hann blocks, half overlapping, each less its mean, averaged."""
    n = min(len(x), length)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    blocks = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    power = np.zeros(n // 2 + 1)
    for b in blocks:
        power += np.abs(np.fft.rfft((b - b.mean()) * hann)) ** 2
    power /= len(blocks) * rate * (hann**2).sum()
    power[1 : len(power) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places of strict local maxima; the middle (rounded down) of flat ones; never an end."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))  # runs of equal values
    last = np.concatenate((first[1:] - 1, [len(x) - 1]))
    v = x[first]
    inner = np.arange(1, len(v) - 1)
    top = inner[(v[inner] > v[inner - 1]) & (v[inner] > v[inner + 1])]
    return (first[top] + last[top]) // 2


def spaced(peaks: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Peaks that stay when the highest removes all nearer than distance, and so on; of equal ones the later first."""
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            a, b = np.searchsorted(peaks, [peaks[i] - distance + 1, peaks[i] + distance])
            keep[a:i] = False
            keep[i + 1 : b] = False
    return peaks[keep]


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prominence and the bases (lowest places before a higher sample) of each peak."""
    n, left, right = len(peaks), np.zeros(len(peaks), np.int64), np.zeros(len(peaks), np.int64)
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x[:p][::-1] > x[p])
        a = p - higher[0] if len(higher) else 0
        left[k] = p - np.argmin(x[a : p + 1][::-1])
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        b = p + higher[0] if len(higher) else len(x) - 1
        right[k] = p + np.argmin(x[p : b + 1])
    return (x[peaks] - np.maximum(x[left], x[right]) if n else np.zeros(0)), left, right


def find_peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, prominence: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Peaks by height, then by distance, then by prominence; and their prominences (zeros if not asked for)."""
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and distance > 1:
        peaks = spaced(peaks, x[peaks], distance)
    if prominence is None:
        return peaks, np.zeros(len(peaks))
    own, _, _ = prominences(x, peaks)
    return peaks[own >= prominence], own[own >= prominence]


def half_widths(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Widths at half the prominence, with interpolated crossings."""
    own, left, right = prominences(x, peaks)
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        level = x[p] - 0.5 * own[k]
        i = p
        while i > left[k] and x[i] > level:
            i -= 1
        a = i + ((level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else 0.0)
        i = p
        while i < right[k] and x[i] > level:
            i += 1
        b = i - ((level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else 0.0)
        out[k] = b - a
    return out


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(x)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * keep)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Biased autocorrelation at all lags, 1 at lag 0."""
    y = x - x.mean()
    size = 1 << max(1, 2 * len(y) - 1).bit_length()
    f = np.fft.rfft(y, size)
    out = np.fft.irfft(f * f.conj(), size)[: len(y)]
    return out / max(out[0], 1e-20)


def band_sections(low: float, high: float, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a Butterworth band-pass; edges are parts of the Nyquist frequency.

    The poles of the analogue prototype are moved to the band and through the
    bilinear transform; each section takes a conjugate pair and the zeros 1, -1.
    """
    edges = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre2 = edges[1] - edges[0], edges[0] * edges[1]
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    p = np.exp(1j * angles) * width / 2
    root = np.sqrt(p**2 - centre2 + 0j)
    poles = np.concatenate([p + root, p - root])
    gain = width**order * np.real(np.prod(4.0 + 0 * poles[:order]) / np.prod(4 - poles))
    digital = (4 + poles) / (4 - poles)
    digital = digital[np.argsort(np.abs(digital))]
    pairs, rest = [], list(digital)
    while rest:
        z = rest.pop(0)
        k = int(np.argmin(np.abs(np.array(rest) - np.conj(z))))
        pairs.append((z, rest.pop(k)))
    out = []
    for i, (a, b) in enumerate(pairs):
        scale = gain if i == 0 else 1.0
        out.append((scale * np.array([1.0, 0.0, -1.0]), np.real(np.array([1.0, -(a + b), a * b]))))
    return out


#: Steps of a lane, and samples from which a section runs in lanes.
STEPS, LANES_FROM = 128, 2048


def _lanes(b: tuple, a1: float, a2: float, x: np.ndarray, state: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """One section over lanes of STEPS samples at once: each from zero, then what its entering state adds."""
    b0, b1, b2 = b
    lanes = x.reshape(-1, STEPS).T
    out, s1, s2 = np.empty(lanes.shape), np.zeros(lanes.shape[1]), np.zeros(lanes.shape[1])
    step, row = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([1.0, 0.0])
    answer = np.empty((STEPS, 2))
    for t, v in enumerate(lanes):
        own = out[t] = b0 * v + s1
        s1 = b1 * v - a1 * own + s2
        s2 = b2 * v - a2 * own
        answer[t] = row
        row = row @ step
    (p, q), (r, s) = np.linalg.matrix_power(step, STEPS).tolist()
    entering = []
    for f1, f2 in zip(s1.tolist(), s2.tolist()):
        entering.append(state)
        state = (p * state[0] + q * state[1] + f1, r * state[0] + s * state[1] + f2)
    return (out + answer @ np.array(entering).T).T.ravel(), state


def filtered(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, states: list | None = None) -> tuple[np.ndarray, list]:
    """x through all sections one after the other, and their states after it, for the next part of the series."""
    states = [tuple(map(float, s)) for s in states] if states is not None and len(states) else [(0.0, 0.0)] * len(sections)
    y = np.array(x, float)
    whole = len(y) // STEPS * STEPS if len(y) >= LANES_FROM else 0
    for k, (b, a) in enumerate(sections):
        b0, b1, b2 = b.tolist()
        a1, a2 = float(a[1]), float(a[2])
        state = states[k]
        if whole:
            y[:whole], state = _lanes((b0, b1, b2), a1, a2, y[:whole], state)
        s1, s2 = state
        rest = y[whole:].tolist()
        for i, v in enumerate(rest):
            rest[i] = out = b0 * v + s1
            s1 = b1 * v - a1 * out + s2
            s2 = b2 * v - a2 * out
        y[whole:] = rest
        states[k] = (s1, s2)
    return y, states


def steady(sections) -> list[np.ndarray]:
    """States of each section when its input has been 1 times what the sections before let through for ever."""
    out, level = [], 1.0
    for b, a in sections:
        gain = b.sum() / a.sum()
        s2 = b[2] - a[2] * gain
        s1 = b[1] - a[1] * gain + s2
        out.append(level * np.array([s1, s2]))
        level *= gain
    return out


def band_pass(x: np.ndarray, rate: float, low: float, high: float, order: int = 4, zero_phase: bool = False) -> np.ndarray:
    """x in a band of frequencies; zeros where the band or the series is too small."""
    nyquist = rate / 2
    high = min(high, 0.98 * nyquist)
    if len(x) < 16 or rate <= 0 or low <= 0 or high <= low or low >= nyquist:
        return np.zeros(len(x))
    sections = band_sections(low / nyquist, high / nyquist, order)
    if not zero_phase:
        return filtered(sections, x)[0]
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        ext = filtered(sections, ext, [s * ext[0] for s in steady(sections)])[0][::-1]
    return ext[pad : len(ext) - pad]


def dominant_bin(x: np.ndarray) -> tuple[int, float, float]:
    """Bin, period in samples and amplitude share of the largest amplitude; (0, NaN, 0) for a constant or tiny series."""
    x = x[np.isfinite(x)]
    if len(x) < 4 or x.std() <= 1e-12:
        return 0, float("nan"), 0.0
    amp = np.abs(np.fft.rfft(x - x.mean()))
    amp[0] = 0
    k = int(np.argmax(amp))
    return k, (len(x) / k if k else float("nan")), float(amp[k] / amp.sum()) if amp.sum() > 1e-20 else 0.0


def spectrum(x: np.ndarray) -> np.ndarray:
    """Amplitudes without the mean, summing to 1 (or all 0)."""
    amp = np.abs(np.fft.rfft(x - np.nanmean(x))) if len(x) >= 4 else np.zeros(1)
    amp[0] = 0
    return amp / amp.sum() if amp.sum() > 1e-20 else np.zeros_like(amp)


def hann_features(x: np.ndarray, rate: float, bands: list[tuple[float, float]]) -> dict[str, float]:
    """Dominant frequency, power ratio, centroid, entropy and band ratios (edges included) of a Hann-windowed series."""
    n = len(x)
    names = [f"band{i}_ratio" for i in range(len(bands))]
    empty = {"dom_freq": 0.0, "dom_ratio": 0.0, "centroid": 0.0, "entropy": 0.0} | dict.fromkeys(names, 0.0)
    if n < 4 or x.std() <= 1e-12:
        return empty
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(n))) ** 2
    freq = np.fft.rfftfreq(n, 1 / rate)
    power[0] = 0
    total = power.sum()
    if total <= 1e-20:
        return empty
    p, k = power / total, int(np.argmax(power))
    entropy = float(-(p * np.log(p + 1e-20)).sum() / np.log(max(2, len(p))))
    shares = {name: float(power[(freq >= a) & (freq <= b)].sum() / total) for name, (a, b) in zip(names, bands)}
    return {"dom_freq": float(freq[k]), "dom_ratio": float(p[k]), "centroid": float((freq * p).sum()), "entropy": entropy} | shares


def moving_mean(x: np.ndarray, width: int, kind: str = "B") -> np.ndarray:
    """Mean over causal or centred (convention B) frames that shrink at the ends."""
    n, width = len(x), max(1, int(width))
    left = width - 1 if kind == "causal" else (width - 1) // 2
    at = np.arange(n)
    a, b = np.maximum(at - left, 0), np.minimum(at + width - left, n)
    total = np.concatenate(([0.0], np.cumsum(x)))
    return (total[b] - total[a]) / (b - a)


def top_bins(x: np.ndarray, k: int) -> np.ndarray:
    """The part of x in the bins whose amplitude exceeds the k-th largest one (so k - 1 bins, without ties), the mean left out."""
    f = np.fft.rfft(x)
    amp = np.abs(f)
    amp[0] = 0
    k = min(k, len(amp))
    if k <= 0:
        return np.zeros(len(x))
    f[amp <= np.sort(amp)[-k]] = 0
    return np.fft.irfft(f, n=len(x))
