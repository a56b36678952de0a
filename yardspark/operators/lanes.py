"""Many frames of one video linked side by side, with the ids of one pass.

The frames are cut into lanes. Each lane but the first links some frames before its own from nothing, as what a linker
holds mostly depends on the last frames alone, and one step takes the next frame of every lane, by arrays. Where a
lane's tracks at its start are not exactly those at the end of the lane before, it is linked again from those, frame by
frame; so is a lane in which two tracks were ever equal in all but their ids, as only ids of one pass tell those apart.
"""

from __future__ import annotations

import numpy as np

from yardspark.operators.tracking import ACTIVE, LOST, LOST_FRAMES, LOST_IOU, SURE_IOU, Linker

#: Frames before its own from which a lane begins, least frames of its own, and lanes at least and at most.
WARM, OWN, LEAST, MOST = 128, 256, 16, 256


def link_frames(linker: Linker, numbers: np.ndarray, firsts: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The ids that the linker gives boxes (a row each), whose frames have these numbers and first rows; firsts ends
    with the number of rows. The linker goes on from there."""
    lanes = min(MOST, (len(numbers) - WARM) // OWN)
    if lanes < LEAST or not (np.diff(numbers) > 0).all() or not np.isfinite(boxes).all() or any(t[1] >= numbers[0] for t in linker.tracks):
        return _one_by_one(linker, numbers, firsts, boxes)
    linker.forget(int(numbers[0]))
    size = -(-(len(numbers) - WARM) // lanes)
    lanes = -(-(len(numbers) - WARM) // size)
    ends = np.minimum(WARM + size * np.arange(1, lanes + 1), len(numbers))
    ids, twins, at_start, at_end = _side_by_side(linker, numbers, firsts, np.ascontiguousarray(boxes.T, float), size * np.arange(lanes), ends)
    held, true, following = at_end.tracks(0), at_end.ids(0), int(at_end.following[0])
    for k in range(1, lanes):
        begin, end = int(ends[k - 1]), int(ends[k])
        own = slice(firsts[begin], firsts[end])
        if twins[k] or not np.array_equal(at_start.tracks(k), held):
            again = Linker([[i, int(c[0]), *c[1:]] for i, c in zip(true.tolist(), held.T.tolist(), strict=True)], following)
            ids[own] = _one_by_one(again, numbers[begin:end], firsts[begin : end + 1] - firsts[begin], boxes[own])
            again.forget(int(numbers[end - 1]))
            held, true, following = np.array([t[1:] for t in again.tracks], float).reshape(-1, 7).T, np.array([t[0] for t in again.tracks], np.int64), again.next_id
            continue
        born = int(at_start.following[k])
        known = np.zeros(born, np.int64)
        known[at_start.ids(k)] = true
        real = lambda local: np.where(local < born, known[np.minimum(local, born - 1)], local - born + following)  # noqa: E731, B023
        ids[own] = real(ids[own])
        held, true, following = at_end.tracks(k), real(at_end.ids(k)), following + int(at_end.following[k]) - born
    linker.tracks, linker.next_id, linker.last = [[i, int(c[0]), *c[1:]] for i, c in zip(true.tolist(), held.T.tolist(), strict=True)], following, None
    return ids


def _one_by_one(linker: Linker, numbers: np.ndarray, firsts: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    rows, at, ids = boxes.tolist(), firsts.tolist(), []
    for number, a, z in zip(numbers.tolist(), at[:-1], at[1:], strict=True):
        ids += linker.frame(number, rows[a:z])
    return np.array(ids, np.int64)


class _Held:
    """The tracks of all lanes: columns of frame, box and velocity, lane by lane in the linker's order."""

    def __init__(self, columns: np.ndarray, lane: np.ndarray, ids: np.ndarray, following: np.ndarray):
        self.columns, self.lane, self._ids, self.following = columns, lane, ids, following

    def _of(self, k: int) -> slice:
        return slice(*np.searchsorted(self.lane, [k, k + 1]))

    def tracks(self, k: int) -> np.ndarray:
        return self.columns[:, self._of(k)]

    def ids(self, k: int) -> np.ndarray:
        return self._ids[self._of(k)]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, as many as it counts."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _fitting(now: np.ndarray, box: np.ndarray, i: np.ndarray, j: np.ndarray, rule: tuple, sure: float) -> tuple:
    """(pairs that fit as in `tracking.fitting`, the best first, their overlap); of equal scores the first pairs come first."""
    far, least, a, b = rule
    (l, u, r, d), (x1, y1, x2, y2) = now.take(i, 1), box.take(j, 1)
    iw, ih = np.minimum(r, x2) - np.maximum(l, x1), np.minimum(d, y2) - np.maximum(u, y1)
    meet = np.flatnonzero((iw > 0) & (ih > 0))
    i, j, inner = i[meet], j[meet], iw[meet] * ih[meet]
    (l, u, r, d), (x1, y1, x2, y2) = now.take(i, 1), box.take(j, 1)
    w, h = r - l, d - u
    o = inner / np.maximum(w * h + (x2 - x1) * (y2 - y1) - inner, 1e-9)
    dx, dy = (l + r) / 2 - (x1 + x2) / 2, (u + d) / 2 - (y1 + y2) / 2
    off = np.sqrt(dx * dx + dy * dy) / np.maximum(np.sqrt(w * w + h * h), 1e-9)
    fit = np.flatnonzero(((off <= far) & (o >= least)) | (o > sure))
    o = o[fit]
    best = np.argsort(-(a * o + b * np.maximum(1 - off[fit] / far, 0.0)), kind="stable")
    return i[fit][best], j[fit][best], o[best]


def _side_by_side(linker: Linker, numbers: np.ndarray, firsts: np.ndarray, boxes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple:
    """(ids within each lane of its own boxes, lanes with equal tracks, what lanes hold at their start and at their end)."""
    lanes, n = len(begins), len(linker.tracks)
    ids, twins = np.zeros(boxes.shape[1], np.int64), np.zeros(lanes, bool)
    tracks, lane, name = np.array([t[1:] for t in linker.tracks], float).reshape(n, 7).T, np.zeros(n, np.int16), np.array([t[0] for t in linker.tracks], np.int64)
    following = np.ones(lanes, np.int64)
    following[0] = linker.next_id
    number, at_start = np.zeros(lanes), None
    for s in range(int((ends - begins).max())):
        if s == WARM:
            at_start = _Held(tracks, lane, name, following.copy())
        on = np.flatnonzero(begins + s < ends)
        call = begins[on] + s
        number[on] = numbers[call]
        count = np.zeros(lanes, np.int64)
        count[on] = firsts[call + 1] - firsts[call]
        place = np.cumsum(count) - count
        rows, of = _runs(firsts[call], count[on]), np.repeat(on, count[on])
        box = boxes.take(rows, 1)
        gap = number[lane] - tracks[0]
        now = tracks[1:5] + np.concatenate((tracks[5:], tracks[5:])) * gap
        # tracks beside all boxes of their lane fit none
        edges = np.full((4, lanes), [[-np.inf], [-np.inf], [np.inf], [np.inf]])
        edges[:2, on], edges[2:, on] = np.maximum.reduceat(box[2:], place[on], axis=1), np.minimum.reduceat(box[:2], place[on], axis=1)
        right, down, left, up = edges.take(lane, 1)
        kept = gap <= LOST_FRAMES + 1
        near, active = kept & (now[0] < right) & (now[1] < down) & (now[2] > left) & (now[3] > up), gap <= 1
        given, used = [-1] * len(rows), set()

        def take(i: np.ndarray, j: np.ndarray) -> None:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if given[b] < 0 and a not in used:  # noqa: B023
                    given[b] = a  # noqa: B023
                    used.add(a)  # noqa: B023

        some = np.flatnonzero(near & active)
        many = count[lane[some]]
        i, j, o = _fitting(now, box, np.repeat(some, many), _runs(place[lane[some]], many), ACTIVE, SURE_IOU)
        sure = np.flatnonzero(o > SURE_IOU)
        sure = sure[np.lexsort((j[sure], i[sure], -o[sure]))]
        take(i[sure], j[sure])
        take(i, j)
        rest = np.flatnonzero(np.array(given) < 0)
        open_ = np.bincount(of[rest], minlength=lanes)
        some = np.flatnonzero(near & ~active)
        many = open_[lane[some]]
        i, j, _ = _fitting(now, box, np.repeat(some, many), rest[_runs((np.cumsum(open_) - open_)[lane[some]], many)], LOST, LOST_IOU)
        take(i, j)
        to = np.array(given)
        new, old = np.flatnonzero(to < 0), np.flatnonzero(to >= 0)
        before, known = to[old], box.take(old, 1)
        named = np.empty(len(rows), np.int64)
        named[old] = name[before]
        more = np.bincount(of[new], minlength=lanes)
        named[new] = _runs(following, more)
        following += more
        put = np.zeros((7, len(rows)))
        put[0], put[1:5] = number[of], box
        was = tracks.take(before, 1)
        put[5:, old] = ((known[:2] + known[2:]) - (was[1:3] + was[3:5])) / 2 / np.maximum(gap[before], 1)
        own = len(rows) if s >= WARM else int(count[0])
        ids[rows[:own]] = named[:own]
        # the changed tracks go behind the others of their lane, in the linker's order
        order = np.lexsort((put[2], put[1], of))
        alike = np.flatnonzero((np.diff(put[1][order]) == 0) & (np.diff(put[2][order]) == 0) & (np.diff(of[order]) == 0))
        if len(alike):
            alike = np.union1d(alike, alike + 1)
            at = order[alike]
            at = at[np.lexsort((named[at], *put[:0:-1, at], of[at]))]
            order[alike] = at
            twins[of[at[1:]][(put[:, at[1:]] == put[:, at[:-1]]).all(0) & (of[at[1:]] == of[at[:-1]])]] = True
        kept[before] = False
        stay = np.flatnonzero(kept)
        lane = np.concatenate((lane[stay], of[order].astype(np.int16)))
        to = np.argsort(lane, kind="stable")
        from_ = np.concatenate((stay, order + len(name)))[to]
        tracks, lane, name = np.concatenate((tracks, put), axis=1).take(from_, 1), lane[to], np.concatenate((name, named))[from_]
    return ids, twins, at_start, _Held(tracks, lane, name, following)
