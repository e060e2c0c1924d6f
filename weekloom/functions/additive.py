"""Additive series model for one short series: trend with bends, yearly cycle and event effects.

The form is that of Taylor and Letham, *Forecasting at Scale* (2017). The posterior mode is found by alternating
ridge solves: the Laplace prior of the trend bends becomes a ridge weight that is renewed in each round. Several
histories (the cutoffs of a backtest) and several prior scales are solved at once. Inside, the axes of an array are
history, prior scale, row, column; shorter histories are filled up with rows of zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

YEAR_DAYS = 365.25
FOURIER_ORDER = 10
BENDS = 25
BEND_SHARE = 0.8
ROUNDS = 10
TOLERANCE = 1e-3
AT_ONCE = 32  # histories times prior scales that are solved together
Z95 = 1.959963984540054
TREND_SCALE = 5.0
EVENT_SCALE = 10.0


def yearly_terms(days: np.ndarray) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / YEAR_DAYS, np.arange(1, FOURIER_ORDER + 1))
    return np.concatenate([np.sin(angle), np.cos(angle)], axis=1)


def trend_terms(t: np.ndarray, bends: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(t), t, np.maximum(0.0, t[:, None] - bends[None, :])])


@dataclass
class Additive:
    """Fitted parameters; the first axis of each array runs over the prior scales."""

    start: float
    span: float
    scale: float
    bends: np.ndarray
    multiplicative: bool
    trend: np.ndarray
    season: np.ndarray
    events: np.ndarray
    sigma: np.ndarray
    converged: np.ndarray

    def predict(self, days: np.ndarray, events: np.ndarray) -> dict[str, np.ndarray]:
        t = (days - self.start) / self.span
        trend = self.trend @ trend_terms(t, self.bends).T
        season = self.season @ yearly_terms(days).T
        effect = self.events @ events.T
        yhat = trend * (1 + effect + season) if self.multiplicative else trend * (1 + effect) + season
        # Beyond the history the slope may bend again as often and as much as it did before.
        ahead = np.maximum(0.0, t - 1.0)
        jump = np.abs(self.trend[:, 2:]).mean(axis=1) if len(self.bends) else np.zeros(len(self.trend))
        wander = len(self.bends) * 2 * jump[:, None] ** 2 * ahead[None, :] ** 3 / 3
        width = Z95 * np.sqrt(self.sigma[:, None] ** 2 + wander)
        unit = 1.0 if self.multiplicative else self.scale
        return {
            "yhat": yhat * self.scale,
            "yhat_lower": (yhat - width) * self.scale,
            "yhat_upper": (yhat + width) * self.scale,
            "trend": trend * self.scale,
            "yearly": season * unit,
        }


def _turned(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def _solve(gram: np.ndarray, right: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    weighted = gram + penalty[..., None] * np.eye(penalty.shape[-1])
    return np.linalg.solve(weighted, right[..., None])[..., 0]


def _ridge(design: np.ndarray, target: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    turned = _turned(design)
    return _solve(turned @ design, (turned @ target[..., None])[..., 0], penalty)


class _Products:
    """Inner products of the trend and season columns, with the trend columns also weighted by the events.

    The trend enters as lines * (1 + x b). Its products are quadratic in b, so they are formed once from the rows
    and then only added up for each b.
    """

    def __init__(self, lines: np.ndarray, waves: np.ndarray, x: np.ndarray, z: np.ndarray):
        many, rows, p = lines.shape
        weights = np.concatenate([np.ones((many, rows, 1)), x], axis=2)
        k = weights.shape[2]
        scaled = (_turned(weights)[..., None] * lines[:, None]).swapaxes(1, 2).reshape(many, rows, k * p)
        every = _turned(scaled) @ scaled
        self.line_line = every.reshape(many, k, p, k, p).transpose(0, 1, 3, 2, 4).reshape(many, k * k, p * p)
        self.line_wave = (_turned(scaled) @ waves).reshape(many, k, -1)
        self.line_z = (_turned(scaled) @ z[..., None]).reshape(many, k, p)
        self.wave_wave = (_turned(waves) @ waves)[:, None]
        self.wave_z = (_turned(waves) @ z[..., None])[:, None, :, 0]

    def at(self, effect: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.concatenate([np.ones((*effect.shape[:2], 1)), effect], axis=2)
        axes, p, w = c.shape[:2], self.line_z.shape[2], self.wave_z.shape[2]
        pairs = (c[..., :, None] * c[..., None, :]).reshape(*axes, -1)
        gram = np.empty((*axes, p + w, p + w))
        side = (c @ self.line_wave).reshape(*axes, p, w)
        gram[..., :p, :p] = (pairs @ self.line_line).reshape(*axes, p, p)
        gram[..., :p, p:], gram[..., p:, :p] = side, _turned(side)
        gram[..., p:, p:] = self.wave_wave
        right = np.concatenate([c @ self.line_z, np.broadcast_to(self.wave_z, (*axes, w))], axis=2)
        return gram, right


def _bends(t: np.ndarray) -> np.ndarray:
    history = int(np.floor(len(t) * BEND_SHARE))
    count = min(BENDS, max(history - 1, 0))
    return t[np.linspace(0, history - 1, count + 1).round().astype(int)[1:]] if count else t[:0]


def fit(
    days: np.ndarray,
    y: np.ndarray,
    events: np.ndarray,
    bend_scales: np.ndarray,
    season_scales: np.ndarray,
    multiplicative: bool = False,
) -> Additive:
    return fit_many([(days, y, events)], bend_scales, season_scales, multiplicative)[0]


def fit_many(
    histories: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]],
    bend_scales: np.ndarray,
    season_scales: np.ndarray,
    multiplicative: bool = False,
) -> list[Additive]:
    """A model for each history (days, y, events), as if each was fitted alone."""
    out: list[Additive] = []
    step = max(1, AT_ONCE // len(bend_scales))
    bends = [_bends((days - days.min()) / max(np.ptp(days), 1.0)) for days, _, _ in histories]
    first = 0
    while first < len(histories):
        last = first + 1
        while last < min(first + step, len(histories)) and len(bends[last]) == len(bends[first]):
            last += 1
        out += _fit_alike(histories[first:last], np.array(bends[first:last]), bend_scales, season_scales, multiplicative)
        first = last
    return out


def _fit_alike(
    histories: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]],
    bends: np.ndarray,
    bend_scales: np.ndarray,
    season_scales: np.ndarray,
    multiplicative: bool,
) -> list[Additive]:
    """Histories with the same number of bends, solved together."""
    sizes = np.array([len(y) for _, y, _ in histories])
    cuts, many, rows = len(histories), len(bend_scales), sizes.max()
    p, w, r = 2 + bends.shape[1], 2 * FOURIER_ORDER, histories[0][2].shape[1]
    lines, waves = np.zeros((cuts, rows, p)), np.zeros((cuts, rows, w))
    x, z, used = np.zeros((cuts, rows, r)), np.zeros((cuts, rows)), np.zeros((cuts, 1, rows))
    start, span, scale, spread = (np.zeros(cuts) for _ in range(4))
    for i, (days, y, events) in enumerate(histories):
        n = sizes[i]
        start[i], span[i], scale[i] = days.min(), max(np.ptp(days), 1.0), float(np.abs(y).max()) or 1.0
        lines[i, :n], waves[i, :n] = trend_terms((days - start[i]) / span[i], bends[i]), yearly_terms(days)
        x[i, :n] = events * (np.ptp(events, axis=0) > 0)  # a column of zeros gets no effect
        z[i, :n], used[i, 0, :n] = y / scale[i], 1
        spread[i] = z[i, :n].var()

    season, effect = np.zeros((cuts, many, w)), np.zeros((cuts, many, r))
    trend = np.full((cuts, many, p), 0.1)
    noise = np.repeat(np.maximum(spread, 1e-8)[:, None], many, axis=1)
    fixed = np.full((cuts, many, 2), 1 / TREND_SCALE**2)
    smooth = np.broadcast_to(1 / season_scales[:, None] ** 2, (cuts, many, w))
    free = np.full((cuts, many, r), 1 / EVENT_SCALE**2)
    target = z[:, None]
    products = None if multiplicative else _Products(lines, waves, x, z)
    both = np.concatenate([waves, x], axis=2)
    settled = np.zeros((cuts, many), dtype=bool)
    for _ in range(ROUNDS):
        soft = 1 / (bend_scales[:, None] * np.maximum(np.abs(trend[..., 2:]), 1e-6))
        before = (trend, season, effect, noise)
        if multiplicative:
            level = 1 + effect @ _turned(x) + season @ _turned(waves)
            weights = noise[..., None] * np.concatenate([fixed, soft], axis=2)
            trend = _ridge(lines[:, None] * level[..., None], target, weights)
            g = trend @ _turned(lines)
            weights = noise[..., None] * np.concatenate([smooth, free], axis=2)
            found = _ridge(g[..., None] * both[:, None], target - g, weights)
            season, effect = found[..., :w], found[..., w:]
            error = target - g * (1 + found @ _turned(both))
        else:
            weights = noise[..., None] * np.concatenate([fixed, soft, smooth], axis=2)
            found = _solve(*products.at(effect), weights)
            trend, season = found[..., :p], found[..., p:]
            g, s = trend @ _turned(lines), season @ _turned(waves)
            if r:
                effect = _ridge(g[..., None] * x[:, None], target - g - s, noise[..., None] * free)
            error = target - g * (1 + effect @ _turned(x)) - s
        noise = np.maximum(((error * used) ** 2).sum(axis=2) / sizes[:, None], 1e-8)
        # What has settled stays as it is, so that a result does not depend on what is solved beside it.
        after = (trend, season, effect, noise)
        trend, season, effect, noise = (
            np.where(settled.reshape(cuts, many, *[1] * (old.ndim - 2)), old, new) for old, new in zip(before, after, strict=True)
        )
        settled |= np.abs(noise - before[3]) <= TOLERANCE * before[3]
        if settled.all():
            break
    sigma = np.sqrt(noise)
    return [
        Additive(
            float(start[i]), float(span[i]), float(scale[i]), bends[i], multiplicative,
            trend[i], season[i], effect[i], sigma[i], settled[i],
        )
        for i in range(cuts)
    ]
