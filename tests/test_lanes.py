"""Frames of one video linked side by side against one pass."""

import random

import numpy as np
import pytest
from test_tracking import walk

from yardspark.operators import lanes, tracking


def columns(rows):
    rows = sorted((r for r in rows if r[7] >= tracking.LEAST_CONF), key=lambda r: (r[1], r[2]))
    frames, boxes = np.array([r[1] for r in rows]), np.array([r[3:7] for r in rows], float)
    firsts = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1))
    return frames[firsts], np.append(firsts, len(frames)), boxes


def both(numbers, firsts, boxes, cut):
    """Ids and linkers of one pass, and of lanes from the state at the cut on."""
    linkers = tracking.Linker(), tracking.Linker()
    ids = [lanes._one_by_one(k, numbers[:cut], firsts[: cut + 1], boxes[: firsts[cut]]) for k in linkers]
    rest = numbers[cut:], firsts[cut:] - firsts[cut], boxes[firsts[cut] :]
    ids[0] = np.append(ids[0], lanes._one_by_one(linkers[0], *rest))
    ids[1] = np.append(ids[1], lanes.link_frames(linkers[1], *rest))
    for k in linkers:
        k.forget(int(numbers[-1]))
    return ids, linkers


@pytest.mark.parametrize(("warm", "own", "most"), [(0, 20, 256), (5, 20, 256), (40, 30, 256), (64, 20, 3), (64, 100, 256)])
def test_lanes_equal_one_pass(monkeypatch, warm, own, most):
    """many frames are linked side by side, also where lanes begin without frames before them, where equal boxes meet,
    and from a state; the linker goes on as after one pass."""
    for name, value in (("WARM", warm), ("OWN", own), ("LEAST", 2), ("MOST", most)):
        monkeypatch.setattr(lanes, name, value)
    rng = random.Random(warm + own)
    for things, grid, twins in ((1, 0, 0), (4, 0, 0), (6, 10, 0), (5, 0, 0.05), (5, 10, 0.05)):
        rows = [r if not grid else (*r[:3], *[round(x / grid) * float(grid) for x in r[3:7]], r[7]) for r in walk(rng, "a", 500, things)]
        rows += [(r[0], r[1], r[2] + 100, *r[3:]) for r in rows if rng.random() < twins]
        rows = [r for r in rows if r[1] not in (77, 78) and not 200 < r[1] < 240]
        for cut in (0, 9):
            ids, linkers = both(*columns(rows), cut)
            assert ids[0].tolist() == ids[1].tolist()
            assert linkers[0].tracks == linkers[1].tracks and linkers[0].next_id == linkers[1].next_id


def test_few_frames_are_linked_one_by_one(monkeypatch):
    """lanes converge on given boxes, so that hardly any of their frames is linked by itself."""
    numbers, firsts, boxes = columns(walk(random.Random(1), "a", 6000, 4))
    single, one = [], lanes._one_by_one
    monkeypatch.setattr(lanes, "_one_by_one", lambda linker, n, *more: single.append(len(n)) or one(linker, n, *more))
    want = one(tracking.Linker(), numbers, firsts, boxes)
    assert lanes.link_frames(tracking.Linker(), numbers, firsts, boxes).tolist() == want.tolist() and sum(single) < len(numbers) / 2


def test_frames_that_do_not_rise_or_have_no_numbers(monkeypatch):
    monkeypatch.setattr(lanes, "LEAST", 1)
    monkeypatch.setattr(lanes, "WARM", 10)
    monkeypatch.setattr(lanes, "OWN", 10)
    numbers, firsts, boxes = columns(walk(random.Random(2), "a", 200, 3))
    holes = boxes.copy()
    holes[50, 2] = np.nan
    for n, b in ((numbers, holes), (np.append(numbers[100:], numbers[:100]), boxes)):
        assert lanes.link_frames(tracking.Linker(), n, firsts, b).tolist() == lanes._one_by_one(tracking.Linker(), n, firsts, b).tolist()
