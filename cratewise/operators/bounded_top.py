"""Top successors inside one dense cell, without scoring all of its pairs.

The targets of a cell fall into buckets of like tempo, energy, section, vocals
and recency. From a bucket's ranges follows an upper bound of any source's score
there; inside a bucket targets lie in name order, which breaks ties. A source
reads the bucket with the highest bound first, a few targets at a time, and
stops when no bucket's bound, with the name of its next target, can beat the
last of the successors it already has. What it reads depends on how many scores
tie, not on how many targets the cell holds.
"""

from __future__ import annotations

import numpy as np

STEP = 16  # targets that a source reads of a bucket at a time
BOUNDS = 1 << 15  # bounds, of a source and a bucket, that are worked on together
MOST_BUCKETS = 4096
FEW_BUCKETS = 32
BUCKET_ROWS = 64  # targets of a bucket, on the average, before there are more buckets than few
NAMES = 1 << 40  # above every name position
SLACK = 1e-9  # scores are compared up to rounding
RATIOS = (0.0, 1.0, -1.0)


class Cell:
    """Targets of one cell, by bucket, then name: ``log`` tempo, ``energy``, ``vocal``, ``section``, ``recent``, ``artist`` code, ``name``."""

    def __init__(self, targets: dict[str, np.ndarray]) -> None:
        fixed = np.stack([targets["energy"], targets["section"], targets["recent"]], axis=1).astype(float)
        # A source looks at every bucket, so they are fewer than the targets.
        most = min(MOST_BUCKETS, max(FEW_BUCKETS, len(fixed) // BUCKET_ROWS))
        _, plain = np.unique(fixed, axis=0, return_inverse=True)
        plain = plain.ravel().astype(np.int64)
        for per_octave, shades in ((1024, 128), (512, 64), (512, 16), (256, 16), (128, 8), (64, 8), (32, 4), (16, 4), (4, 2), (1, 1)):
            tempo = np.floor(targets["log"] * per_octave).astype(np.int64)
            shade = np.floor(np.clip(targets["vocal"], 0, 1) * shades).astype(np.int64)
            code = (plain * (shades + 1) + shade) * (1 << 24) + tempo - tempo.min()
            if len(np.unique(code)) <= most:
                break
        self.order = np.lexsort((targets["name"], code))
        for name, values in targets.items():
            setattr(self, name, values[self.order])
        code = code[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.ends = np.append(self.starts[1:], len(code))
        self.low, self.high = np.minimum.reduceat(self.log, self.starts), np.maximum.reduceat(self.log, self.starts)
        self.least_vocal = np.minimum.reduceat(self.vocal, self.starts)


def best_pairs(sources: dict[str, np.ndarray], cell: Cell, k: int, weights: dict[str, float], tolerance: float,
               artist_penalty: float, recent_penalty: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of sources and targets that hold every source's best ``k`` of this cell, and how many pairs were scored.

    ``sources``: ``log`` tempo, ``energy``, ``vocal``, ``artist`` code (-1: none),
    ``h`` (the key's score) and ``floor``, under which a total need not be found.
    """
    found_s, found_t, scored = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    together = min(1024, max(16, BOUNDS // len(cell.starts)))
    for at in range(0, len(sources["log"]), together):
        s = {name: values[at:at + together] for name, values in sources.items()}
        rows, cols, n = _chunk(s, cell, k, weights, tolerance, artist_penalty, recent_penalty)
        found_s.append(rows + at)
        found_t.append(cols)
        scored += n
    return np.concatenate(found_s), cell.order[np.concatenate(found_t)], scored


def _points(total: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(total, 0, 1) * 100 + 0.5).astype(np.int64)


def _chunk(s, cell: Cell, k, weights, tolerance, artist_penalty, recent_penalty):
    first = cell.starts
    n = len(s["log"])
    away = np.full((n, len(first)), np.inf)
    for shift in RATIOS:
        x = (s["log"] + shift)[:, None]
        away = np.minimum(away, np.maximum(0, np.maximum(cell.low[None, :] - x, x - cell.high[None, :])))

    def total(tempo, energy_gap, section, vocals, recent):
        return (np.maximum(0, 1 - tempo / tolerance) * weights["tempo"] + (s["h"] * weights["key"])[:, None]
                + np.maximum(0, 1 - np.abs(energy_gap - 1) / 4) * weights["energy"] + section * weights["section"]
                + np.maximum(0, 1 - 1.6 * vocals) * weights["vocals"] - recent * recent_penalty)

    bound = total(away, cell.energy[first][None, :] - s["energy"][:, None], cell.section[first][None, :],
                  s["vocal"][:, None] * cell.least_vocal[None, :], cell.recent[first][None, :]) + SLACK
    least = s["floor"] - 0.01 - SLACK
    points = _points(bound) * NAMES
    keys = np.where(bound > least[:, None], points - cell.name[first][None, :], np.iinfo(np.int64).min)
    place = np.broadcast_to(first, keys.shape).copy()
    top = np.full((n, k), np.iinfo(np.int64).min)
    rows_out, cols_out, hopes, scored = [], [], [], 0
    everyone = np.arange(n)
    while True:
        bucket = keys.argmax(axis=1)
        active = np.flatnonzero(keys[everyone, bucket] > top.min(axis=1))
        if not len(active):
            break
        b = bucket[active]
        begin = place[active, b]
        cols = begin[:, None] + np.arange(STEP)
        there = cols < cell.ends[b][:, None]
        cols = np.minimum(cols, len(cell.log) - 1)
        scored += int(there.sum())
        gap = np.full(cols.shape, np.inf)
        for shift in RATIOS:
            gap = np.minimum(gap, np.abs(cell.log[cols] - (s["log"][active] + shift)[:, None]))
        own = {name: values[active] for name, values in s.items()}
        value = (np.maximum(0, 1 - gap / tolerance) * weights["tempo"] + (own["h"] * weights["key"])[:, None]
                 + np.maximum(0, 1 - np.abs(cell.energy[cols] - own["energy"][:, None] - 1) / 4) * weights["energy"]
                 + cell.section[cols] * weights["section"]
                 + np.maximum(0, 1 - 1.6 * own["vocal"][:, None] * cell.vocal[cols]) * weights["vocals"]
                 - ((cell.artist[cols] == own["artist"][:, None]) & (own["artist"][:, None] >= 0)) * artist_penalty
                 - cell.recent[cols] * recent_penalty)
        there &= value > least[active][:, None] - SLACK
        # A pair counts with the least points that rounding may leave it, and is kept for the most.
        sure = np.where(there, _points(value - SLACK) * NAMES - cell.name[cols], np.iinfo(np.int64).min)
        hoped = _points(value + SLACK) * NAMES - cell.name[cols]
        keep = there & (hoped >= top[active].min(axis=1)[:, None])
        r, c = np.nonzero(keep)
        rows_out.append(active[r])
        cols_out.append(cols[r, c])
        hopes.append(hoped[r, c])
        both = np.concatenate([top[active], sure], axis=1)
        top[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        begin = begin + STEP
        place[active, b] = begin
        left = begin < cell.ends[b]
        following = cell.name[np.minimum(begin, len(cell.log) - 1)]
        keys[active, b] = np.where(left, points[active, b] - following, np.iinfo(np.int64).min)
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), scored
    rows, cols = np.concatenate(rows_out), np.concatenate(cols_out)
    keep = np.concatenate(hopes) >= top.min(axis=1)[rows]
    return rows[keep], cols[keep], scored
