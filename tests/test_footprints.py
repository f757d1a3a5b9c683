"""Rims of cells as rings, holes and their parents, simplification."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import footprints
from stratagrid.operators.polygons import NOTHING


def frame(spark, masks):
    rows = [(s, int(r), int(c), 1.0) for s, m in masks.items() for r, c in zip(*np.nonzero(m))] + [("none", 0, 0, None)]
    return spark.createDataFrame(rows, "source string, row long, col long, value double").repartition(3)


def area(points):
    return -sum(p[1] * -q[0] - q[1] * -p[0] for p, q in zip(points, points[1:] + points[:1])) / 2 * -1


def inside(points, r, c):
    x, y, odd = c + 0.5, r + 0.5, False
    for (r0, c0), (r1, c1) in zip(points, points[1:] + points[:1]):
        if (r0 > y) != (r1 > y) and x < (c1 - c0) * (y - r0) / (r1 - r0) + c0:
            odd = not odd
    return odd


def masks():
    rng = np.random.default_rng(3)
    spiral = np.zeros((21, 21), bool)
    r, c, d, n = 10, 10, 0, 0
    for k in range(1, 20):
        for _ in range(k):
            spiral[r, c] = True
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
            if not (0 <= r < 21 and 0 <= c < 21):
                break
        d = (d + 1) % 4
        if not (0 <= r < 21 and 0 <= c < 21):
            break
    nested = np.ones((9, 9), bool)
    nested[1:8, 1:8] = False
    nested[2:7, 2:7] = True
    nested[3:6, 3:6] = False
    nested[4, 4] = True
    holes = np.ones((5, 12), bool)
    holes[2, 1:11:2] = False
    board = np.indices((6, 6)).sum(0) % 2 == 0
    return {"random": rng.random((25, 30)) < 0.6, "dense": rng.random((25, 30)) < 0.9, "spiral": spiral, "nested": nested, "holes": holes, "board": board, "one": np.ones((1, 1), bool)}


def test_rings(spark):
    given = masks()
    got = {}
    for r in footprints.rings(frame(spark, given)).collect():
        got.setdefault(r["source"], []).append((tuple(r["ring"]), r["outer"], tuple(r["parent"]), [(p["row"], p["col"]) for p in r["points"]]))
    assert got.keys() == given.keys()
    for s, m in given.items():
        rings = got[s]
        # corners turn, and neighbours share a row or a column
        for _, _, _, p in rings:
            assert all((a[0] == b[0]) != (a[1] == b[1]) and (a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(p, p[1:] + p[:1], p[2:] + p[:2]))
        signed = {k: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(p, p[1:] + p[:1])) for k, _, _, p in rings}
        assert len({v > 0 for (k, outer, _, _), v in zip(rings, signed.values()) if outer}) == 1
        total = sum(abs(signed[k]) * (1 if outer else -1) for k, outer, _, _ in rings) / 2
        assert total == m.sum()
        # each cell is in an odd number of rings if it has data, an even one if it has none
        for r in range(m.shape[0]):
            for c in range(m.shape[1]):
                assert sum(inside(p, r, c) for _, _, _, p in rings) % 2 == m[r, c]
        # parts hang together by sides: as many outer rims as components
        left, parts = {tuple(x) for x in np.argwhere(m)}, 0
        while left:
            parts += 1
            todo = [left.pop()]
            while todo:
                r, c = todo.pop()
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if n in left:
                        left.remove(n)
                        todo.append(n)
        assert sum(outer for _, outer, _, _ in rings) == parts
        by = {k: p for k, outer, _, p in rings if outer}
        for k, outer, parent, p in rings:
            assert parent in by and (parent == k if outer else True)
            if not outer:
                # the smallest outer rim around a hole is its own
                r, c = min(p)
                around = [k2 for k2, q in by.items() if inside(q, r, c - 1 if (c and m[r, c - 1]) else c)]
                assert parent == min(around, key=lambda k2: abs(signed[k2]))


def test_footprint(spark):
    got = {r["source"]: r for r in footprints.footprint(frame(spark, masks()), origin=(100.0, 50.0), resolution=2.0).collect()}
    assert got["one"]["parts"] and sorted((p["x"], p["y"]) for p in got["one"]["parts"][0][0]) == [(100, 48), (100, 50), (102, 48), (102, 50)]
    assert [len(p) for p in got["holes"]["parts"]] == [6] and got["holes"]["cells"] == 55
    assert sorted(len(p) for p in got["nested"]["parts"]) == [1, 2, 2] and len(got["board"]["parts"]) == 18


def test_simplification(spark):
    yy, xx = np.indices((60, 60))
    disc = {"disc": (yy - 30) ** 2 + (xx - 30) ** 2 < 625}
    whole = footprints.footprint(frame(spark, disc)).first()
    for tolerance in (0.8, 3.0):
        few = footprints.footprint(frame(spark, disc), tolerance=tolerance).first()
        full, ring = whole["parts"][0][0], few["parts"][0][0]
        assert 4 <= len(ring) < len(full) / (1.5 if tolerance < 1 else 3) and {(p["x"], p["y"]) for p in ring} <= {(p["x"], p["y"]) for p in full}
        for p in full:
            def off(a, b, p=p):
                dx, dy = b["x"] - a["x"], b["y"] - a["y"]
                t = max(0, min(1, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy)))
                return math.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)
            assert min(off(a, b) for a, b in zip(ring, ring[1:] + ring[:1])) <= tolerance + NOTHING
