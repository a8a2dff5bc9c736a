"""Numpy helpers for what columns can't express; each works on one chunk of samples."""

from __future__ import annotations

import numpy as np

#: The two K-weighting biquads of BS.1770 at 48 kHz.
K_B1, K_A1 = np.array([1.53512485958697, -2.69169620938640, 1.19839281085285]), np.array([1.0, -1.69065929318241, 0.73248077421585])
K_B2, K_A2 = np.array([1.0, -2.0, 1.0]), np.array([1.0, -1.99004745483398, 0.99007225036621])
#: The analog filters behind them (corner, quality; the shelf's gain in dB and the exponent of its midpoint).
K_SHELF, K_PASS = (1681.974450955533, 0.7071752369554196, 3.999843853973347, 0.4996667741545416), (38.13547087602444, 0.5003270373238773)
#: Samples at 48 kHz after which the weighting's impulse response is below 1e-16.
K_TAIL = 8192


def k_tail(rate: int) -> int:
    return int(np.ceil(K_TAIL * rate / 48_000))


def k_biquads(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numerator, denominator) of the two weighting stages at a rate; at 48 kHz the standard's own digits."""
    return [(K_B1, K_A1), (K_B2, K_A2)] if rate == 48_000 else derived_biquads(rate)


def derived_biquads(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The stages from the analog filters. Where the shelf's corner would pass the Nyquist frequency it stands at 0.45 of the rate."""
    corner, q, gain_db, middle = K_SHELF
    k, high = np.tan(np.pi * min(corner, 0.45 * rate) / rate), 10 ** (gain_db / 20)
    mid, low = high**middle, 1 + k / q + k * k
    shelf = np.array([high + mid * k / q + k * k, 2 * (k * k - high), high - mid * k / q + k * k]) / low, np.array([low, 2 * (k * k - 1), 1 - k / q + k * k]) / low
    corner, q = K_PASS
    k = np.tan(np.pi * corner / rate)
    low = 1 + k / q + k * k
    return [shelf, (K_B2, np.array([low, 2 * (k * k - 1), 1 - k / q + k * k]) / low)]


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size))


def k_magnitude(freqs: np.ndarray) -> np.ndarray:
    """Magnitude of the weighting at these frequencies, as for 48 kHz; 0 for a first bin at 0 Hz."""
    z = np.exp(-2j * np.pi * np.minimum(freqs, 23_999.0) / 48_000)
    value = lambda c: c[0] + c[1] * z + c[2] * z * z
    out = np.abs(value(K_B1) * value(K_B2) / (value(K_A1) * value(K_A2)))
    if len(out) and freqs[0] == 0:
        out[0] = 0
    return out


def k_response(rate: int = 48_000) -> np.ndarray:
    """The weighting's impulse response at a rate; k_tail(rate) samples hold it all."""
    n = k_tail(rate)
    z = np.exp(-2j * np.pi * np.arange(2 * n + 1) / (4 * n))
    value = lambda c: c[0] + c[1] * z + c[2] * z * z
    out = np.ones(len(z), complex)
    for above, under in k_biquads(rate):
        out *= value(above) / value(under)
    return np.fft.irfft(out, 4 * n)[:n]


def k_filtered(x: np.ndarray, halo: int, rate: int = 48_000) -> np.ndarray:
    """x filtered at its rate, without the first `halo` samples, which are there for the filter's memory."""
    h = k_response(rate)
    size = 1 << int(np.ceil(np.log2(len(x) + len(h))))
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[halo : len(x)]


def mono(i: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray]:
    """The first place, and from there the mean of all channels at each place; NaN where there is no sample."""
    first, known = int(i.min()), ~np.isnan(x)
    size = int(i.max()) + 1 - first
    n = np.bincount(i[known] - first, minlength=size)
    return first, np.where(n > 0, np.bincount(i[known] - first, x[known], size) / np.maximum(n, 1), np.nan)


def window_sums(v: np.ndarray, n: int) -> np.ndarray:
    """Sums of every n values in a row. Each is the end of one block of n and the start of the next, so nothing cancels after loud values."""
    blocks = np.concatenate([v, np.zeros(-len(v) % n)]).reshape(-1, n)
    starts, ends = blocks.cumsum(1).ravel(), blocks[:, ::-1].cumsum(1)[:, ::-1].ravel()
    at = np.arange(max(len(v) - n + 1, 0))
    return np.where(at % n == 0, starts[at + n - 1], ends[at] + starts[at + n - 1])


def click_ratios(x: np.ndarray, low: int, start: int, stop: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in [start, stop) and their step to the next sample over the RMS of a centred window, held at the track's ends.
    x begins at place `low`, with `window` samples of halo before start and window + 1 after stop unless the track ends there; missing samples are NaN."""
    end = low + len(x)
    n = min(window, end) if low == 0 else window
    places = np.arange(start, min(stop, end - 1))
    if not len(places):
        return places, np.zeros(0)
    at = np.maximum(0, np.minimum(places - max((n - 2) // 2, 0), end - n))
    power = window_sums(np.nan_to_num(x) ** 2, n)[at - low] / n
    step = np.abs(np.diff(x))[places - low]
    known = ~np.isnan(step)
    return places[known], step[known] / np.sqrt(np.maximum(power[known], 1e-12))


def oversampled_peak(x: np.ndarray, factor: int = 4, reach: int = 24) -> float:
    """Largest magnitude of x and of `factor` - 1 windowed-sinc values between each two samples. x carries `reach` samples of halo at both ends."""
    if not len(x):
        return 0.0
    best = float(np.abs(x).max())
    k = np.arange(-reach + 1, reach + 1)
    for part in range(1, factor):
        t = k - part / factor
        kernel = np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / reach))
        best = max(best, float(np.abs(np.convolve(x, kernel[::-1], "same")).max()))
    return best


def spectra(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Hann-windowed magnitude spectra of the full frames."""
    return np.abs(np.fft.rfft(framed(x, size, hop) * np.hanning(size), axis=1))


def centroid_entropy(mag: np.ndarray, rate: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    freqs, total = np.fft.rfftfreq(size, 1 / rate), mag.sum(1)
    sound = total > 1e-10
    p = mag / np.where(sound, total, 1)[:, None]
    entropy = -(np.where(p > 1e-10, p * np.log2(np.where(p > 1e-10, p, 1)), 0)).sum(1)
    return np.where(sound, p @ freqs, 0), np.where(sound, entropy, 0)


def band_powers(x: np.ndarray, rate: int, size: int, hop: int, bands: list[tuple[float, float]], weighted: bool = True) -> np.ndarray:
    """Per frame, the power in each band, scaled as amplitude."""
    freqs = np.fft.rfftfreq(size, 1 / rate)
    mag = spectra(x, size, hop) * (2.0 / size) * (k_magnitude(freqs) if weighted else 1.0)
    return np.stack([(mag[:, (freqs >= lo) & (freqs < hi)] ** 2).sum(1) for lo, hi in bands], 1) if len(mag) else np.zeros((0, len(bands)))


def frame_powers(frames: np.ndarray) -> np.ndarray:
    """Power of the bins of each Hann-windowed frame."""
    return np.abs(np.fft.rfft(frames * np.hanning(frames.shape[1]), axis=1)) ** 2


def mean_of_band(power: np.ndarray, size: int, rate: int, lo: float, hi: float) -> np.ndarray:
    """Mean of the bins in [lo, hi) of each frame's powers; size is a frame's samples."""
    freqs = np.fft.rfftfreq(size, 1 / rate)
    mask = (freqs >= lo) & (freqs < min(hi, rate / 2))
    return power[:, mask].mean(1) if mask.any() else np.zeros(len(power))


def mean_band_power(frames: np.ndarray, rate: int, lo: float, hi: float) -> np.ndarray:
    """Mean power of the bins in [lo, hi) of each Hann-windowed frame."""
    return mean_of_band(frame_powers(frames), frames.shape[1], rate, lo, hi)


def flatness(power: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of each frame's powers, without the first bin."""
    power = power[:, 1:] + 1e-18
    return np.exp(np.log(power).mean(1)) / power.mean(1)


#: Stop band of the resampling filter in dB, its transition as a share of the lower Nyquist frequency (half of it on each side), and the Kaiser window's shape for it.
STOP_DB, TRANSITION = 95.0, 0.18
BETA = 0.1102 * (STOP_DB - 8.7)


def resample_reach(up: int, down: int) -> int:
    """Input samples that an output sample needs on each side: the filter grows with the ratio when the rate falls."""
    periods = (STOP_DB - 8) / (2.285 * TRANSITION * np.pi) / 2
    return int(np.ceil(periods * max(1.0, down / up))) + 1


def polyphase_bank(up: int, down: int) -> np.ndarray:
    """For each of the `up` phases the weights of the 2 * reach input samples around an output sample; each phase's weights add up to 1."""
    reach, cut = resample_reach(up, down), min(1.0, up / down)
    t = np.arange(-reach + 1, reach + 1)[None] - np.arange(up)[:, None] / up
    bank = np.sinc(cut * t) * np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / reach) ** 2)))
    return bank / bank.sum(1, keepdims=True)


def resampled(x: np.ndarray, begin: int, start: int, stop: int, n: int, bank: np.ndarray, up: int, down: int) -> tuple[int, np.ndarray]:
    """(first, y): the output samples whose place in the input, k * down / up, is in [start, stop) and before n. x holds the input
    from place `begin`; what it doesn't reach is silence."""
    first, last = -(-start * up // down), -(-min(stop, n) * up // down)
    k = np.arange(first, last, dtype=np.int64)
    if not len(k):
        return first, np.zeros(0)
    reach, base = bank.shape[1] // 2, k * down // up
    low, high = int(base[0]) - reach + 1, int(base[-1]) + reach + 1
    wide = np.zeros(high - low)
    a, b = max(low, begin), min(high, begin + len(x))
    wide[a - low : b - low] = x[a - begin : b - begin]
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach)[base - base[0]]
    return first, np.einsum("kj,kj->k", windows, bank[k * down % up])
