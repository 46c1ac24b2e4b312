"""Rolling spectra by blocks of rows, and models of whole series, one Arrow group per symbol: wavelets, change points, hidden states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .blocks import BLOCK, over_windows
from .recursive import scan

#: Low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def spectrum(df: DataFrame, n: int = 100, block: int = BLOCK) -> DataFrame:
    """Over the n rows before each row: spectral_entropy (null before), dominant_freq and dominant_power (0 before)."""

    def make(d):
        x = d["close"]
        out = {"spectral_entropy": np.full(len(x), np.nan), "dominant_freq": np.zeros(len(x)), "dominant_power": np.zeros(len(x))}
        if len(x) > n:
            amp = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n)[:-1], axis=1))
            power = amp**2
            share = power / power.sum(1, keepdims=True)
            out["spectral_entropy"][n:] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
            peak = amp[:, 1:].argmax(1) + 1
            out["dominant_freq"][n:] = peak / n
            out["dominant_power"][n:] = amp[np.arange(len(amp)), peak]
        return out

    return over_windows(df, make, ["spectral_entropy", "dominant_freq", "dominant_power"], n, ("close",), block)


def wavelet(df: DataFrame, levels: int = 5) -> DataFrame:
    """Share of the energy in each detail level of a periodic db4 transform, a constant column per level."""
    low = np.array(DB4)
    high = low[::-1] * (-1) ** np.arange(len(low))

    def make(d):
        approx, energies = d["close"] - (d["close"].mean() if len(d["close"]) else 0.0), []
        for _ in range(levels):
            if len(approx) < len(low):
                energies.append(0.0)
                continue
            at = (2 * np.arange((len(approx) + 1) // 2)[:, None] + np.arange(len(low))) % len(approx)
            energies.append(float(((approx[at] @ high) ** 2).sum()))
            approx = approx[at] @ low
        total = sum(energies) + float((approx**2).sum()) or 1.0
        return {f"wavelet_energy_level_{i + 1}": np.full(len(d["close"]), e / total) for i, e in enumerate(energies)}

    return scan(df, make, [f"wavelet_energy_level_{i + 1}" for i in range(levels)])


def change_points(df: DataFrame, penalty: float = 10.0, least: int = 30) -> DataFrame:
    """is_change: 1 on the first row of each segment of piecewise constant means of standardised closes.

    Optimal partitioning with pruned candidates (PELT); segment costs come from prefix sums.
    """

    def make(d):
        x = d["close"]
        n = len(x)
        z = (x - x.mean()) / (x.std() or 1.0) if n else x
        s, q = np.r_[0.0, np.cumsum(z)], np.r_[0.0, np.cumsum(z * z)]
        best, before = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        best[0] = -penalty
        live = np.array([0])
        for t in range(least, n + 1):
            ready = live[live <= t - least]
            cost = q[t] - q[ready] - (s[t] - s[ready]) ** 2 / (t - ready)
            total = best[ready] + cost + penalty
            k = int(total.argmin())
            best[t], before[t] = total[k], ready[k]
            kept = ready[best[ready] + cost <= best[t]]
            live = np.r_[kept, live[live > t - least], t]
        flags, t = np.zeros(n), n if n >= least else 0
        while t > 0:
            t = before[t]
            if t:
                flags[t] = 1.0
        return {"is_change": flags}

    return scan(df, make, ["is_change"])


def hidden_states(df: DataFrame, states: int = 3, rounds: int = 30) -> DataFrame:
    """Most likely state of a Gaussian hidden Markov model of returns, states numbered by their mean.

    Starts from quantile means, learns by scaled forward-backward passes and decodes by the Viterbi path.
    """

    def make(d):
        c = d["close"]
        r = np.r_[0.0, np.diff(c) / np.where(c[:-1] == 0, np.nan, c[:-1])] if len(c) else c
        r = np.nan_to_num(r)
        if len(r) < 5 * states:
            return {"regime_hmm": np.zeros(len(r))}
        mean = np.quantile(r, (np.arange(states) + 0.5) / states)
        var = np.full(states, r.var() + 1e-8)
        move, first = np.full((states, states), 0.1 / max(states - 1, 1)), np.full(states, 1 / states)
        np.fill_diagonal(move, 0.9)

        def dense():
            return np.exp(-0.5 * (r[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300

        for _ in range(rounds):
            p = dense()
            ahead, scale, back = np.empty_like(p), np.empty(len(r)), np.ones_like(p)
            for t in range(len(r)):
                row = p[t] * (first if t == 0 else ahead[t - 1] @ move)
                scale[t] = row.sum()
                ahead[t] = row / scale[t]
            for t in range(len(r) - 2, -1, -1):
                back[t] = move @ (p[t + 1] * back[t + 1]) / scale[t + 1]
            post = ahead * back
            post /= post.sum(1, keepdims=True)
            both = (ahead[:-1, :, None] * move * (p[1:] * back[1:])[:, None, :] / scale[1:, None, None]).sum(0)
            move = both / both.sum(1, keepdims=True)
            first, mass = post[0], post.sum(0)
            mean = (post * r[:, None]).sum(0) / mass
            var = (post * (r[:, None] - mean) ** 2).sum(0) / mass + 1e-8
        p, lm = np.log(dense()), np.log(move + 1e-300)
        value, came = np.log(first + 1e-300) + p[0], np.zeros((len(r), states), int)
        for t in range(1, len(r)):
            options = value[:, None] + lm
            came[t] = options.argmax(0)
            value = options.max(0) + p[t]
        path = np.empty(len(r), int)
        path[-1] = value.argmax()
        for t in range(len(r) - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        rank = np.empty(states, int)
        rank[np.argsort(mean)] = np.arange(states)
        return {"regime_hmm": rank[path].astype(float)}

    return scan(df, make, ["regime_hmm"])
