"""Reading order: mesh cuts, comparators, inline notes and whole pages."""

import random
from functools import cmp_to_key
from statistics import median

import numpy as np
import pytest

from inkwell.functions import mesh
from inkwell.operators import order as od

SCHEMA = "page long, id long, pos int, x1 double, y1 double, x2 double, y2 double"


def frame(spark, pages):
    return spark.createDataFrame([(p, i, i, *map(float, b)) for p, boxes in enumerate(pages) for i, b in enumerate(boxes)], SCHEMA)


def ids(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.page, r.rank)):
        out.setdefault(r.page, []).append(r.id)
    return out


def cell_by_cell(boxes, grid):
    """Mesh ranks, cell by cell and by recursion."""
    b = mesh.on_mesh(np.array(boxes), grid).tolist()
    width, height = max(x[2] for x in b) + 1, max(x[3] for x in b) + 1
    covered = [[any(x[0] <= c < x[2] and x[1] <= r < x[3] for x in b) for c in range(width)] for r in range(height)]

    def run(counts):
        if len(counts) == 1:
            return 0, 1, counts[0]
        runs = []
        for i, c in enumerate(counts):
            if c == min(counts) and (i == 0 or counts[i - 1] != c):
                j = i
                while j < len(counts) and counts[j] == c:
                    j += 1
                runs.append((i, j))
        i, j = max(runs, key=lambda r: r[1] - r[0])
        return i, j, -min(counts) / max(counts) if max(counts) else 0

    def tree(x0, y0, x1, y1):
        xb, xe, xw = run([sum(covered[r][c] for r in range(y0, y1)) for c in range(x0, x1)])
        yb, ye, yw = run([sum(covered[r][c] for c in range(x0, x1)) for r in range(y0, y1)])
        if (xe - xb, ye - yb) == (x1 - x0, y1 - y0):
            return (x0, y0, x1, y1), []
        if xw > yw or xw == yw and xe - xb >= ye - yb:
            parts = [(x0, y0, x0 + xb, y1), (x0 + xb, y0, x0 + xe, y1), (x0 + xe, y0, x1, y1)]
        else:
            parts = [(x0, y0, x1, y0 + yb), (x0, y0 + yb, x1, y0 + ye), (x0, y0 + ye, x1, y1)]
        return (x0, y0, x1, y1), [tree(*p) for p in parts if p[0] < p[2] and p[1] < p[3] and p != (x0, y0, x1, y1)]

    def leaves(node):
        return [node[0]] if not node[1] else [x for n in node[1] for x in leaves(n)]

    def share(box, leaf):
        w, h = min(box[2], leaf[2]) - max(box[0], leaf[0]) + 1, min(box[3], leaf[3]) - max(box[1], leaf[1]) + 1
        both = max(0, w) * max(0, h)
        total = (box[2] - leaf[0] + 1) * (box[3] - leaf[1] + 1) + (leaf[2] - box[0] + 1) * (leaf[3] - box[1] + 1) - both
        return both / total if total else float("inf") if both else float("-inf")

    root = tree(0, 0, width, height)
    of = {i: max(range(len(leaves(root))), key=lambda k: share(x, leaves(root)[k])) for i, x in enumerate(b)}
    upright = lambda held: len(held) < 2 * sum(b[i][2] - b[i][0] < b[i][3] - b[i][1] for i in held)

    def read(node):
        if not node[1]:
            held = [i for i in range(len(b)) if leaves(root)[of[i]] == node[0]]
            return sorted(held, key=lambda i: (-b[i][0], b[i][1]) if upright(held) else (b[i][1], b[i][0]))
        parts = [read(n) for n in node[1]]
        across = all((n[0][1], n[0][3]) == (node[0][1], node[0][3]) for n in node[1])
        return [i for p in (parts[::-1] if across and upright([i for p in parts for i in p]) else parts) for i in p]

    return read(root)


def random_page(rng, n, side=60):
    out = []
    for _ in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        out.append((x, y, x + rng.randrange(1, 14), y + rng.randrange(1, 14)))
    return out


def test_mesh_cuts_equal_cell_by_cell(spark):
    rng = random.Random(6)
    pages = [random_page(rng, rng.randrange(1, 9)) for _ in range(60)] + [[(0, 0, 10, 10)] * 3, [(5, 5, 5, 5), (0, 0, 9, 3)], [(9, 9, 1, 1)]]
    for boxes in pages:
        assert np.argsort(mesh.mesh_ranks(np.array(boxes), 25.0)).tolist() == cell_by_cell(boxes, 25.0)
    got = ids(od.mesh_order(frame(spark, pages[:20]), ["page"]))
    assert got == {p: np.argsort(mesh.mesh_ranks(np.array(b))).tolist() for p, b in enumerate(pages[:20])}
    assert len(mesh.mesh_ranks(np.zeros((0, 4)))) == 0


def test_lines_grow_across():
    tall = mesh.on_mesh(np.array([[0, 0, 10, 100], [40, 0, 50, 100], [80, 0, 82, 100]]), 100.0, 1.4)
    plain = mesh.on_mesh(np.array([[0, 0, 10, 100], [40, 0, 50, 100], [80, 0, 82, 100]]), 100.0)
    assert tall[1, 2] - tall[1, 0] > plain[1, 2] - plain[1, 0] and tall[2, 2] - tall[2, 0] <= 4


def test_line_order_is_that_of_the_comparator(spark):
    rng = random.Random(7)
    pages = [random_page(rng, rng.randrange(1, 40), 120) for _ in range(40)]

    def want(boxes):
        tall = sum(b[2] - b[0] < b[3] - b[1] for b in boxes) * 2 > len(boxes)
        margin = 0.3 * median((b[2] - b[0]) if tall else (b[3] - b[1]) for b in boxes)

        def before(i, j):
            (ax, ay), (bx, by) = (((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in (boxes[i], boxes[j]))
            d, e = (bx - ax, ay - by) if tall else (ay - by, ax - bx)
            return -1 if d < -margin else 1 if d > margin else e

        return sorted(range(len(boxes)), key=cmp_to_key(before))

    assert ids(od.line_order(frame(spark, pages), ["page"])) == {p: want(b) for p, b in enumerate(pages)}
    chain = [(100, 100, 120, 200), (94, 50, 114, 150), (88, 0, 108, 100)]  # each of one column with the next, not the first with the last
    assert len({tuple(np.array(o)[od._line_order([dict(zip(od.SIDES, chain[i], strict=True)) for i in o])]) for o in ([0, 1, 2], [2, 0, 1], [1, 2, 0])}) > 1


def test_groups_in_columns_of_fifty(spark):
    boxes = [(0, 0, 10, 10), (49, 20, 59, 30), (50, 5, 60, 15), (200, 0, 210, 10)]
    assert ids(od.group_order(frame(spark, [boxes]), ["page"]))[0][0] == 3
    two = lambda gap: ids(od.group_order(frame(spark, [[(0, 0, 10, 10), (gap, 20, gap + 10, 30)]]), ["page"]))[0]
    assert two(49) == [0, 1] and two(50) == [1, 0]


def test_inline_groups_are_greedy(spark):
    #      seed          meets the seed     meets the second only   meets when grown      just does not
    page = [(0, 0, 10, 40), (8, 30, 18, 70), (16, 60, 26, 99), (10.5, 0, 20.5, 30), (11.5, 0, 21.5, 20)]
    got = sorted((r.id, r.seed, r.nth) for r in od.inline_groups(frame(spark, [page]), ["page"]).collect())
    assert got == [(0, 0, 1), (1, 0, 2), (2, 2, 1), (3, 0, 3), (4, 4, 1)]


@pytest.mark.parametrize("counts,want", [([5, 5, 1, 0, 5, 2, 5], (2, 4, 9.0)), ([3, 3, 3], (0, 3, 0.0)), ([0, 0], (0, 2, 0.0)), ([7], (0, 1, 0.0)), ([1, 9, 9, 1], (0, 1, 4.0))])
def test_deepest_gaps(spark, counts, want):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate(counts)], "k string, pos long, n long")
    assert [tuple(r)[1:] for r in od.deepest_gaps(df, ["k"], "pos", "n").collect()] == [want]


def test_page_order_puts_notes_and_containers_in_place(spark):
    rows = [
        # id, container, ord, inline, conf, box: a container of two tall columns with two notes that touch, two loose lines that repeat, one without ord
        (1, "a", 5.0, False, 0.9, 100, 0, 120, 200), (2, "a", 6.0, False, 0.9, 60, 0, 80, 60), (3, None, 7.0, True, 0.9, 72, 70, 82, 120), (4, "a", 8.0, True, 0.9, 61, 70, 71.5, 120),
        (5, None, 1.0, False, 0.5, 300, 0, 320, 100), (6, None, 2.0, False, 0.6, 300, 1, 320, 100), (7, None, None, False, 0.6, 400, 0, 420, 100), (8, None, 99.0, False, 0.6, 0, 0, 20, 100),
    ]
    df = spark.createDataFrame([(1, r[0], r[0], *r[1:5], *map(float, r[5:])) for r in rows], "page long, id long, pos int, container string, ord double, inline boolean, conf double, x1 double, y1 double, x2 double, y2 double")
    assert ids(od.page_order(df, "page"))[1] == [6, 1, 2, 3, 4, 8, 7]
