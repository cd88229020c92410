"""Motion between frames, for stacks of frames as (n, height, width) arrays: flow, warping, and frames in between.

A flow has (dy, dx) on its last axis: what lies at (y, x) of one frame lies at (y + dy, x + dx) of the other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Estimate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def stack(frames, h: int, w: int) -> np.ndarray:
    """A column of flat frames as (n, h, w)."""
    return np.stack([np.asarray(v, float) for v in frames]).reshape(-1, h, w) if len(frames) else np.zeros((0, h, w))


def flat(frames: np.ndarray) -> pd.Series:
    return pd.Series(list(frames.reshape(len(frames), -1)))


def warp(frames: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Each frame sampled where its flow points, between pixels by bilinear weights, beyond the border at the border."""
    n, h, w = frames.shape
    y = np.clip(np.arange(h)[:, None] + flow[..., 0], 0, h - 1)
    x = np.clip(np.arange(w) + flow[..., 1], 0, w - 1)
    top, left = np.floor(y).astype(int), np.floor(x).astype(int)
    below, right = np.minimum(top + 1, h - 1), np.minimum(left + 1, w - 1)
    fy, fx = y - top, x - left
    own = np.arange(n)[:, None, None]
    upper = frames[own, top, left] * (1 - fx) + frames[own, top, right] * fx
    lower = frames[own, below, left] * (1 - fx) + frames[own, below, right] * fx
    return upper * (1 - fy) + lower * fy


def block_flow(a: np.ndarray, b: np.ndarray, reach: int = 2, half: int = 1) -> np.ndarray:
    """(dy, dx) of each pixel of a: where its neighbourhood is found in b, within `reach`; of equal matches the nearest."""
    _, h, w = a.shape
    side = 2 * half + 1
    edges = lambda k: ((0, 0), (k, k), (k, k))
    grown, own = np.pad(b, edges(reach + half), mode="edge"), np.pad(a, edges(half), mode="edge")
    steps = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))
    least, best = np.full(a.shape, np.inf), np.zeros((*a.shape, 2))
    for dy, dx in steps:
        off = np.abs(own - grown[:, reach + dy : reach + dy + h + 2 * half, reach + dx : reach + dx + w + 2 * half])
        cost = np.round(sum(off[:, i : i + h, j : j + w] for i in range(side) for j in range(side)), 9)
        nearer = cost < least
        least[nearer], best[nearer] = cost[nearer], (dy, dx)
    return best


def halved(frames: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 pixels; an odd side repeats its last row or column."""
    n, h, w = frames.shape
    even = np.pad(frames, ((0, 0), (0, h % 2), (0, w % 2)), mode="edge")
    return even.reshape(n, (h + 1) // 2, 2, (w + 1) // 2, 2).mean((2, 4))


def smoothed(flow: np.ndarray) -> np.ndarray:
    """Each vector replaced by the median of the 3 x 3 around it: a lone mismatch goes."""
    _, h, w, _ = flow.shape
    grown = np.pad(flow, ((0, 0), (1, 1), (1, 1), (0, 0)), mode="edge")
    return np.median([grown[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)


def patch_flow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """block_flow by neighbourhoods of 5 x 5, which few places have alike."""
    return block_flow(a, b, half=2)


def coarse_to_fine(a: np.ndarray, b: np.ndarray, levels: int = 3, estimate: Estimate = patch_flow) -> np.ndarray:
    """The flow from a to b, from small frames to large ones: each level adds the flow that is left after warping by the last one's.

    So an estimate that reaches r pixels finds shifts of up to about r * (2 ** levels - 1). Levels stop where a side would have fewer than 4 pixels.
    """
    pairs = [(a, b)]
    while len(pairs) < levels and min(pairs[-1][0].shape[1:]) >= 8:
        pairs.append(tuple(halved(x) for x in pairs[-1]))
    flow = np.zeros((*pairs[-1][0].shape, 2))
    for k, (p, q) in enumerate(reversed(pairs)):
        if k:
            h, w = p.shape[1:]
            flow = 2 * flow.repeat(2, 1).repeat(2, 2)[:, :h, :w]
        flow = smoothed(smoothed(flow + estimate(p, warp(q, flow))))
    return flow


def between(a: np.ndarray, b: np.ndarray, times, levels: int = 3, estimate: Estimate = patch_flow, both_ways: bool = True) -> np.ndarray:
    """(n, times, h, w): frames between a and b, which move along the flow and blend by a mask.

    Both are warped to the time and blended as a * m + b * (1 - m): m falls with the time, and a frame
    counts little where it was sampled from beyond its border. With `both_ways` the flow is the mean
    of the one found and the negated one found with the frames swapped.
    """
    _, h, w = a.shape
    flow = coarse_to_fine(a, b, levels, estimate)
    if both_ways:
        flow = (flow - coarse_to_fine(b, a, levels, estimate)) / 2
    rows, columns = np.arange(h)[:, None], np.arange(w)

    def seen(f):
        inside = (np.abs(rows + f[..., 0] - (h - 1) / 2) <= (h - 1) / 2) & (np.abs(columns + f[..., 1] - (w - 1) / 2) <= (w - 1) / 2)
        return np.where(inside, 1.0, 1e-3)

    out = []
    for t in times:
        back, on = -t * flow, (1 - t) * flow
        wa, wb = (1 - t) * seen(back), t * seen(on)
        m = wa / (wa + wb)
        out.append(warp(a, back) * m + warp(b, on) * (1 - m))
    return np.stack(out, 1) if out else np.zeros((len(a), 0, h, w))


def between_flipped(a: np.ndarray, b: np.ndarray, times, **options) -> np.ndarray:
    """The mean of `between` over the frames as they are and mirrored along either axis and both."""
    made = [np.flip(between(np.flip(a, axes), np.flip(b, axes), times, **options), [x + 1 for x in axes]) for axes in ([], [1], [2], [1, 2])]
    return np.mean(made, axis=0)


def motion_model(h: int, w: int, flips: bool = False, **options) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """A model for fill_with over flat frames: n frames between two, at times k / (n + 1)."""

    def generate(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        make = between_flipped if flips else between
        made = make(a.reshape(-1, h, w), b.reshape(-1, h, w), [k / (n + 1) for k in range(1, n + 1)], **options)
        return made.reshape(len(a), n, h * w)

    return generate


def warped(h: int, w: int):
    """A pandas UDF of a frame and its flow (dy of all pixels, then dx of all): the frame sampled along it."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sampled(px: pd.Series, flow: pd.Series) -> pd.Series:
        along = np.stack([np.asarray(f, float) for f in flow]).reshape(-1, 2, h, w) if len(flow) else np.zeros((0, 2, h, w))
        return flat(warp(stack(px, h, w), np.moveaxis(along, 1, 3)))

    return sampled


def scale_of_motion(h: int, w: int, limit: float, estimate: Estimate = block_flow):
    """A pandas UDF of two frames: 1, 0.5 or 0.25.

    The scale is halved where the largest step of the flow exceeds the limit both forward and
    backward: of the frames as they are, and once more of the halved frames, whose steps count double.
    """

    def steps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.minimum(np.abs(estimate(p, q)).max((1, 2, 3)), np.abs(estimate(q, p)).max((1, 2, 3)))

    @F.pandas_udf(T.DoubleType())
    def scale(a: pd.Series, b: pd.Series) -> pd.Series:
        p, q = stack(a, h, w), stack(b, h, w)
        if not len(p):
            return pd.Series([], dtype=float)
        full, half = steps(p, q), 2 * steps(halved(p), halved(q))
        return pd.Series(np.where(full <= limit, 1.0, np.where(half <= limit, 0.5, 0.25)))

    return scale


def flow_distance(h: int, w: int, estimate: Estimate = block_flow):
    """A pandas UDF of two frames: how far pixels move between them, the same in both orders.

    The flow is the mean of the flow forward and of the negated flow backward; the distance is the
    sum of the lengths of its vertical and of its horizontal part. `estimate` may be any dense flow of stacks.
    """

    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        p, q = stack(a, h, w), stack(b, h, w)
        flow = (estimate(p, q) - estimate(q, p)) / 2
        return pd.Series(np.sqrt((flow**2).sum((1, 2))).sum(-1))

    return distance
