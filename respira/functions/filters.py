"""Recursive band-pass filters in the time domain: a cascade of second-order sections with carried state.

A section runs over blocks of BLOCK samples as a linear system: what the state at a block's begin adds to its outputs, and
what its inputs add, are two small matrices. So the recursion costs a product per block, and rows of equal length run together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from respira.functions.signal import fill_linear

BLOCK = 64


def butterworth_sections(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """`order` rows (b0, b1, b2, a1, a2) of a band-pass with gain 1 at the middle of the band."""
    if not 0 < low < high < fs / 2:
        raise ValueError("a band needs 0 < low < high < fs / 2")
    a, b = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    k = np.arange(1, order + 1)
    prototype = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))  # the left half of the unit circle
    half = prototype * (b - a) / 2
    root = np.sqrt(half * half - a * b + 0j)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    upper = z[z.imag > 1e-12]
    pairs = [(p, p.conj()) for p in upper[np.argsort(-np.abs(upper))]]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    pairs += list(zip(real[::2], real[1::2], strict=True))
    out = np.array([[1.0, 0.0, -1.0, -(p + q).real, (p * q).real] for p, q in pairs])  # a zero at either end of the spectrum
    w = np.exp(1j * 2 * np.arctan(np.sqrt(a * b) / (2 * fs)))
    gain = np.prod([(s[0] + s[2] / w**2) / (1 + s[3] / w + s[4] / w**2) for s in out])
    out[:, :3] /= abs(gain) ** (1 / len(out))
    return out


@lru_cache(maxsize=256)
def _system(section: tuple[float, ...], n: int) -> tuple[np.ndarray, ...]:
    """Outputs and end state of n samples, by the state before and by the inputs."""
    b0, b1, b2, a1, a2 = section
    a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(powers[-1] @ a)
    seen = np.array([p[0] for p in powers[:n]])  # what the state adds to each output
    answer = np.array([b0, *(p[0] @ b for p in powers[: n - 1])])
    i = np.arange(n)
    inputs = np.where(i[None, :] >= i[:, None], answer[np.maximum(i[None, :] - i[:, None], 0)], 0.0)
    ends = np.array([powers[n - 1 - j] @ b for j in range(n)])
    return seen, inputs, powers[n], ends


def run_sections(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered rows of x (rows, samples) and the state behind them (sections, rows, 2), from which a next piece goes on."""
    y = np.array(x, dtype=float)
    state = np.zeros((len(sections), len(y), 2)) if state is None else np.array(state, dtype=float)
    for k, section in enumerate(map(tuple, sections)):
        s = state[k]
        for start in range(0, y.shape[1], BLOCK):
            part = y[:, start : start + BLOCK]
            seen, inputs, forward, ends = _system(section, part.shape[1])
            y[:, start : start + BLOCK], s = s @ seen.T + part @ inputs, s @ forward.T + part @ ends
        state[k] = s
    return y, state


def settled(sections: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The state after a constant input, per row its level."""
    out, level = [], np.array(level, dtype=float)
    for b0, b1, b2, a1, a2 in sections:
        a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        out.append(level[:, None] * np.linalg.solve(np.eye(2) - a, b)[None, :])
        level = level * (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array(out)


def both_ways(sections: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward, then backward, over rows continued by odd reflection of `pad` samples: no phase is shifted."""
    pad = min(pad, x.shape[1] - 1)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad else x
    for _ in range(2):
        wide = run_sections(sections, wide, settled(sections, wide[:, 0]))[0][:, ::-1]
    return wide[:, pad : pad + x.shape[1]]


def recursive_bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """A series through the band, missing samples bridged by a line and missing again after it. A band that ends at or
    beyond the Nyquist rate, or a series too short for the reflection, leaves the series; any other wrong band raises."""
    if not 0 < low < high:
        raise ValueError("a band needs 0 < low < high")
    x = np.asarray(x, dtype=float)
    least = 3 * (2 * order + 1)
    if high >= fs / 2 or len(x) <= least or not np.isfinite(x).any():
        return x
    out = both_ways(butterworth_sections(low, high, fs, order), fill_linear(x)[None, :], max(least, int(fs / low)))[0]
    return np.where(np.isfinite(x), out, np.nan)
