"""Cures of fast edges inside one short piece of a run, from tables of all its possible bridges.

Spark cuts the runs into pieces around fast edges (see :mod:`fleetwake.operators.quality`). A
:class:`Bridges` table holds, for the rows that survive, the elapsed time and the speed from every
row to the k-th row after it; the rules read off that table which rows a bridge may leave out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from fleetwake.functions.geo import EARTH_RADIUS_M


@dataclass(frozen=True)
class PositionConfig:
    # Fixed default values.
    nominal_s: float = 300.0
    nominal_tolerance_s: float = 1.0
    min_dt_s: float = 150.0
    max_gap_s: float = 1800.0
    gap_tolerance_s: float = 1.0
    speed_limit: float = 3.0
    max_removal: int = 5
    window_points: int = 15
    min_samples: int = 8
    boundary_factor: float = 10.0
    warning_z: float = 3.0
    scale_floor: float = 0.05
    margin_z: float = 2.0
    merge_gap_edges: int = 2

    @property
    def reach_s(self) -> float:
        return self.max_gap_s + self.gap_tolerance_s


@dataclass
class Cure:
    """Rows to drop and the bridge over them; rows are numbers within the piece.

    ``samples``, ``median`` and ``scale`` describe the calm speeds nearby, ``z`` how far the bridge is
    from them; ``residual_m`` is the distance of a dropped single row from the straight course, and
    ``rival_z`` the score of the other end of its edge.
    """

    skipped: list[int]
    anchor: int
    reconnect: int
    bridge_speed: float
    reason: str
    iteration: int = 0
    samples: int | None = None
    median: float = np.nan
    scale: float = np.nan
    z: float = np.nan
    residual_m: float = np.nan
    rival_z: float = np.nan


@dataclass
class Piece:
    """Rows of one piece in time order."""

    t: np.ndarray  # seconds
    lon: np.ndarray
    lat: np.ndarray
    protected: np.ndarray
    cfg: PositionConfig
    #: Median and scale of the calm speeds of the whole run, where the piece is only a part of it.
    baseline: tuple[float, float] | None = None

    def take(self, rows: np.ndarray) -> Piece:
        return replace(self, t=self.t[rows], lon=self.lon[rows], lat=self.lat[rows], protected=self.protected[rows])

    def mirrored(self) -> Piece:
        """The same rows as seen by a clock that runs backwards."""
        back = self.take(np.arange(len(self.t))[::-1])
        return replace(back, t=-back.t)


def _distance(lon, lat, a, b) -> np.ndarray:
    p, q = np.radians(lat[a]), np.radians(lat[b])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[b] - lon[a]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def _velocity(p: Piece, a: int, b: int) -> np.ndarray:
    """East and north speed at the first row."""
    lat0, lat1 = np.radians(p.lat[[a, b]])
    d = (np.radians(p.lon[b] - p.lon[a]) + np.pi) % (2 * np.pi) - np.pi
    way = np.arctan2(np.sin(d) * np.cos(lat1), np.cos(lat0) * np.sin(lat1) - np.sin(lat0) * np.cos(lat1) * np.cos(d))
    return _distance(p.lon, p.lat, a, b) / (p.t[b] - p.t[a]) * np.array([np.sin(way), np.cos(way)])


def _bend(p: Piece, a: int, b: int, c: int) -> float:
    """Acceleration at b on the way a, b, c; infinite where it can not be told."""
    half = (p.t[c] - p.t[a]) / 2
    turn = float(np.hypot(*(_velocity(p, b, c) - _velocity(p, a, b)))) / half if half > 0 else np.nan
    return turn if np.isfinite(turn) else -np.inf


def _residual(p: Piece, a: int, b: int, c: int) -> float:
    """Distance of b from the point between a and c at its time, on the chord."""
    lon, lat = np.radians(p.lon[[a, b, c]]), np.radians(p.lat[[a, b, c]])
    xyz = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    share = (p.t[b] - p.t[a]) / (p.t[c] - p.t[a])
    course = (1 - share) * xyz[0] + share * xyz[2]
    size = np.linalg.norm(course)
    return float(EARTH_RADIUS_M * np.arccos(np.clip(xyz[1] @ course / size, -1, 1))) if size > 1e-12 else np.nan


class Bridges:
    """``speed[k - 1, i]`` and ``dt[k - 1, i]``: from row i to row i + k, NaN beyond the end.

    ``calm`` bridges have a usable time and at most the speed limit, ``fast`` edges more. ``usable``
    bridges cross no protected row and stay within reach; both only get harder with k.
    """

    def __init__(self, p: Piece):
        self.p, cfg = p, p.cfg
        self.n, self.most = len(p.t), cfg.max_removal + 1
        self.dt = np.full((self.most, self.n), np.nan)
        self.speed = self.dt.copy()
        free = np.zeros(self.dt.shape, bool)
        held = np.concatenate([[0], np.cumsum(p.protected)])
        for k in range(1, min(self.most, self.n - 1) + 1):
            i = np.arange(self.n - k)
            self.dt[k - 1, i] = p.t[i + k] - p.t[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                self.speed[k - 1, i] = np.where(self.dt[k - 1, i] > 0, _distance(p.lon, p.lat, i, i + k) / self.dt[k - 1, i], np.nan)
            free[k - 1, i] = held[i + k] == held[i + 1]
        timed = (self.dt >= cfg.min_dt_s) & (self.dt <= cfg.reach_s)
        self.timed = timed
        self.calm = timed & (self.speed <= cfg.speed_limit)
        self.fast = timed[0] & (self.speed[0] > cfg.speed_limit)
        self.usable = free & (self.dt > 0) & (self.dt <= cfg.reach_s)

    def onward(self) -> np.ndarray:
        """The row that trusted ground goes on to: the next one, the end of the shortest calm bridge over a fast edge, or -1."""
        good = self.calm & self.usable
        good[0] = False
        hop = np.where(self.fast & good.any(0), np.arange(self.n) + 1 + good.argmax(0), -1)
        return np.where(self.calm[0], np.arange(self.n) + 1, hop)

    def trusted(self, onward: np.ndarray) -> list[int]:
        """Rows on trusted ground, from left to right: it begins behind two calm edges and ends where nothing goes on."""
        seeds = np.flatnonzero(self.calm[0, :-1] & self.calm[0, 1:])
        rows, at = [], 0
        while (s := np.searchsorted(seeds, at)) < len(seeds):
            at = int(seeds[s]) + 2
            while at >= 0:
                rows.append(at)
                at = int(onward[at])
            at = rows[-1] + 1
        return rows

    def nearby(self, low: int, high: int, touching: slice) -> tuple[int, float, float]:
        """(number, median, scale) of the calm edges around rows low to high, without the ``touching`` ones."""
        w = self.p.cfg.window_points
        use = np.zeros(self.n, bool)
        use[max(0, low - w) : min(self.n - 1, high + w)] = True
        use[touching] = False
        return len(x := self.speed[0][use & self.calm[0]]), *spread(x, self.p.cfg)


def spread(speeds: np.ndarray, cfg: PositionConfig) -> tuple[float, float]:
    """Median and floored robust scale of some speeds."""
    if not len(speeds):
        return np.nan, np.nan
    middle = float(np.median(speeds))
    return middle, max(1.4826 * float(np.median(np.abs(speeds - middle))), cfg.scale_floor)


def confirmed_hops(b: Bridges) -> list[Cure]:
    """Bridges that trusted ground takes from both sides and that rest only on other such bridges."""
    last = b.n - 1
    sides = []
    for table, turn in ((b, lambda i: i), (Bridges(b.p.mirrored()), lambda i: last - i)):
        onward = table.onward()
        hops = {}
        for i in table.trusted(onward):
            if onward[i] > i + 1:
                end = int(onward[i])
                more = int(onward[end])
                rests = tuple(sorted((turn(end), turn(more)))) if more > end + 1 else None
                hops[tuple(sorted((turn(i), turn(end))))] = (more >= 0, rests)
        sides.append(hops)
    both = sides[0].keys() & sides[1].keys()
    # Doubt spreads from bridges that lead nowhere, or rest on one that a side lacks, to all that rest on them.
    carried: dict = {}
    doubtful = []
    for hop in both:
        for ends, rests in (sides[0][hop], sides[1][hop]):
            if not ends or (rests is not None and rests not in both):
                doubtful.append(hop)
            if rests is not None:
                carried.setdefault(rests, []).append(hop)
    firm = set(both)
    while doubtful:
        hop = doubtful.pop()
        if hop in firm:
            firm.remove(hop)
            doubtful += carried.get(hop, [])
    depth = np.zeros(b.n + 1, int)
    for lo, hi in firm:
        depth[lo + 1] += 1
        depth[hi] -= 1
    depth = np.cumsum(depth)
    out = []
    for lo, hi in sorted(firm):
        if depth[lo + 1 : hi].max() == 1:
            speed = float(b.speed[hi - lo - 1, lo])
            count, middle, scale = b.nearby(lo, hi, slice(lo, hi))
            z = abs(speed - middle) / scale
            out.append(Cure(list(range(lo + 1, hi)), lo, hi, speed, "bidirectionally_confirmed_time_bounded_excursion_cure", samples=count, median=middle, scale=scale, z=z))
    return out


def endpoint_cures(b: Bridges) -> list[Cure]:
    """Lone fast edges between two calm edges on each side, where dropping one end fits clearly better."""
    cfg, found = b.p.cfg, {}
    if b.n < 7:
        return []
    c = b.calm[0]
    i = np.arange(2, b.n - 3)
    for u in i[b.fast[i] & c[i - 2] & c[i - 1] & c[i + 1] & c[i + 2]]:
        count, middle, scale = b.nearby(u, u + 1, slice(u - 1, u + 2))
        if count < cfg.min_samples:
            continue
        # Either end of the edge may be wrong: the bridge over it starts just before it.
        scores = {}
        for drop in (int(u), int(u) + 1):
            if b.calm[1, drop - 1] and not b.p.protected[drop]:
                scores[drop] = abs(b.speed[1, drop - 1] - middle) / scale
        if not scores or (len(scores) == 2 and abs(np.subtract(*scores.values())) < cfg.margin_z):
            continue
        drop = min(scores, key=scores.get)
        rival = max(scores.values()) if len(scores) == 2 else np.nan
        found.setdefault(drop, []).append(
            Cure([drop], drop - 1, drop + 1, float(b.speed[1, drop - 1]), "unique_endpoint_speed_cure", samples=count, median=middle, scale=scale,
                 z=scores[drop], residual_m=_residual(b.p, drop - 1, drop, drop + 1), rival_z=rival)
        )
    return [x[0] for x in found.values() if len(x) == 1]


def boundary_cures(b: Bridges, first_row: bool, last_row: bool) -> list[Cure]:
    """A gross first or last row of a segment beside a long calm stretch, unless some bridge from it is calm."""
    cfg, out = b.p.cfg, []
    for wanted, table in ((first_row, b), (last_row, Bridges(b.p.mirrored()))):
        if not wanted or b.n < cfg.min_samples + 2:
            continue
        gross = table.timed[0, 0] and table.speed[0, 0] > cfg.speed_limit * cfg.boundary_factor
        if gross and not table.p.protected[0] and table.calm[0, 1 : cfg.min_samples + 1].all() and not table.calm[1:, 0].any():
            end, beside = (0, 1) if table is b else (b.n - 1, b.n - 2)
            out.append(Cure([end], beside, beside, float(table.speed[0, 0]), "automatic_boundary_endpoint_speed_cure"))
    return out


def ranked_cures(b: Bridges, label: np.ndarray) -> list[Cure]:
    """The best bridge at each fast edge; where bridges overlap the better rank goes first.

    Rank: fewer rows, less acceleration at its ends, closer to the usual speed, later, lower labels.
    """
    p, cfg = b.p, b.p.cfg
    middle, scale = p.baseline or spread(b.speed[0][b.calm[0]], cfg)
    good = b.calm & b.usable
    best: dict = {}
    for i in map(int, np.flatnonzero(b.fast)):
        # Over the k rows before the edge's end, or over the k rows after its start.
        spans = [next(((i - k, i + 1) for k in range(1, b.most) if i >= k and good[k, i - k]), None), next(((i, i + k + 1) for k in range(1, b.most) if good[k, i]), None)]
        ranks = []
        for lo, hi in filter(None, spans):
            joints = [(lo - 1, lo, hi), (lo, hi, hi + 1)][lo == 0 : 1 + (hi + 1 < b.n)]
            worst = max((_bend(p, *j) for j in joints), default=-np.inf)
            speed = b.speed[hi - lo - 1, lo]
            fit = abs(speed - middle) / scale if np.isfinite(middle) else np.inf
            ranks.append(((hi - lo - 1, worst if np.isfinite(worst) else np.inf, fit, -p.t[lo + 1], tuple(map(int, label[lo + 1 : hi]))), (lo, hi)))
        if ranks:
            rank, span = min(ranks)
            best[span] = min(rank, best.get(span, rank))
    used, out = np.zeros(b.n, bool), []
    for rank, (lo, hi) in sorted((r, s) for s, r in best.items()):
        if not used[lo + 1 : hi].any():
            used[lo + 1 : hi] = True
            reason = "automatic_iterative_endpoint_speed_cure" if rank[0] == 1 else "automatic_iterative_excursion_speed_cure"
            out.append(Cure(list(range(lo + 1, hi)), lo, hi, float(b.speed[hi - lo - 1, lo]), reason, median=middle, scale=scale, z=rank[2]))
    return out


def solve(p: Piece, label: np.ndarray, first_row: bool, last_row: bool, aggressive: bool) -> list[Cure]:
    """All cures of one piece: confirmed bridges before lone ends until neither finds more, then the bolder rules."""
    left, done = np.arange(len(p.t)), []

    def drop(*rules) -> bool:
        """Apply the first of the rules that finds something."""
        nonlocal left
        table = Bridges(p.take(left))
        found = next(filter(None, (rule(table) for rule in rules)), [])
        step = done[-1].iteration + 1 if done else 1
        done.extend(
            replace(c, skipped=[int(left[r]) for r in c.skipped], anchor=int(left[c.anchor]), reconnect=int(left[c.reconnect]), iteration=step) for c in found
        )
        left = np.delete(left, [r for c in found for r in c.skipped]) if found else left
        return bool(found)

    while drop(confirmed_hops, endpoint_cures):
        pass
    if aggressive:
        drop(lambda b: boundary_cures(b, first_row, last_row))
        while drop(lambda b: ranked_cures(b, label[left])):
            pass
    return done


def thin_new_side(p: Piece, trusted_from_s: float) -> list[Cure]:
    """Drop later rows of fast edges until the older row is reached at a plausible speed.

    Only rows from ``trusted_from_s`` on (two calm edges of the run are past) may act as the older row.
    """
    out: list[Cure] = []
    n, at = len(p.t), 0
    step = np.arange(n - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        speed = _distance(p.lon, p.lat, step, step + 1) / np.diff(p.t)
    starts = np.flatnonzero((np.diff(p.t) > 0) & (speed > p.cfg.speed_limit) & ~p.protected[1:] & (p.t[:-1] >= trusted_from_s))
    while (s := np.searchsorted(starts, at)) < len(starts):
        older = int(starts[s])
        later = np.arange(older + 1, n)
        dt = p.t[later] - p.t[older]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (dt > 0) & (_distance(p.lon, p.lat, older, later) / dt > p.cfg.speed_limit) & ~p.protected[later]
        kept = later[~far]
        at = int(kept[0]) if len(kept) else n
        bridge = float(_distance(p.lon, p.lat, older, at) / (p.t[at] - p.t[older])) if at < n and p.t[at] > p.t[older] else np.nan
        out.append(Cure(list(range(older + 1, at)), older, at if at < n else -1, bridge, "automatic_new_side_speed_thinning"))
    return out


NO_ANCHOR = -(2**62)


class Thinning:
    """One stretch of an island of closely spaced rows: which rows fall, given the anchor before it.

    The anchor is the last surviving row. What follows it by less than the limit falls; the first row
    beyond that which no human rejected decides what comes next: it is the new anchor, or, where it is
    uncertain, the next row without doubt is. So every row has one next anchor, and the anchor that a stretch hands
    on is a function of the one it gets.
    """

    def __init__(self, t_us: np.ndarray, human: np.ndarray, limit_us: int):
        self.t, self.limit, self.n = t_us, limit_us, len(t_us)
        live = human != "reject"
        self.able = live & (human != "uncertain")
        self.next_live, self.next_able = (self._next(x) for x in (live, self.able))
        beyond = self.next_live[np.searchsorted(t_us, t_us + limit_us)]
        # n: no further row, the anchor stays; n + 1: an uncertain row ends it and nothing follows.
        self.after = np.where(beyond == self.n, self.n, np.where(self.next_able[beyond] == self.n, self.n + 1, self.next_able[beyond]))

    def _next(self, mark: np.ndarray) -> np.ndarray:
        at = np.where(np.r_[mark, True], np.arange(self.n + 1), self.n)
        return np.minimum.accumulate(at[::-1])[::-1]

    def first(self, anchor: int) -> int:
        """Position of the first anchor in the stretch, or n, or n + 1, as in ``after``."""
        if anchor == NO_ANCHOR:
            return int(self.next_able[0]) if self.next_able[0] < self.n else self.n + 1
        beyond = self.next_live[np.searchsorted(self.t, anchor + self.limit)]
        if beyond == self.n:
            return self.n
        return int(self.next_able[beyond]) if self.next_able[beyond] < self.n else self.n + 1

    def handed_on(self, anchors: np.ndarray) -> np.ndarray:
        """The anchor after the stretch for every anchor before it."""
        last = np.empty(self.n + 2, np.int64)
        last[self.n + 1] = NO_ANCHOR
        for i in range(self.n - 1, -1, -1):
            last[i] = self.t[i] if self.after[i] == self.n else last[self.after[i]]
        first = [self.first(int(a)) for a in anchors]
        return np.array([a if f == self.n else last[f] for a, f in zip(anchors, first)], np.int64)

    def fallen(self, anchor: int) -> np.ndarray:
        drop = np.zeros(self.n, bool)
        at = self.first(anchor)
        if anchor != NO_ANCHOR:
            drop |= self.t < anchor + self.limit
        while at < self.n:
            drop[at + 1 : np.searchsorted(self.t, self.t[at] + self.limit)] = True
            at = int(self.after[at])
        return drop
