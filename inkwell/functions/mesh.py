"""Cuts of a page by how much of it is covered: occupancy of a mesh, counted along both axes from prefix sums."""

from __future__ import annotations

import numpy as np


def lightest_run(counts: list[int], sizes: list[int]) -> tuple[int, int, float]:
    """(begin, end, weight) of the longest run of the smallest count, the first of equally long ones; each count stands
    for a strip of so many cells. The weight is the smallest by the largest count, negative, so that empty runs weigh
    most; the count of a single cell weighs itself."""
    least, most = min(counts), max(counts)
    if len(counts) == 1:
        return 0, 1, float(most) if sizes[0] == 1 else -1.0 if most else 0.0
    begin = end = best = at = length = 0
    for i, (count, size) in enumerate(zip(counts, sizes, strict=True)):
        if count != least:
            at, length = i + 1, 0
            continue
        length += size
        if length > best:
            begin, end, best = at, i + 1, length
    return begin, end, -least / most if most else 0.0


def on_mesh(boxes: np.ndarray, grid: float, scale: float = 1.0) -> np.ndarray:
    """Boxes (whole numbers) in cells, `grid` of them along the page's shorter side. Lines that are not much narrower
    than the median grow across by scale - 1."""
    b = boxes.astype(np.int64)
    b[:, 2:] = np.maximum(b[:, 2:], b[:, :2])
    if scale != 1.0:
        size = b[:, 2:] - b[:, :2]
        least = np.median(size.min(axis=1)) * 0.75
        for axis in (0, 1):
            chosen = (size[:, axis] < size[:, 1 - axis]) & (size[:, axis] >= least)
            more = ((scale - 1.0) * size[chosen, axis] // 2).astype(np.int64)
            b[chosen, axis] -= more
            b[chosen, axis + 2] += more
    origin = b[:, :2].min(axis=0)
    width, height = b[:, 2:].max(axis=0) - origin
    cells = grid if width < height else grid * (width / max(height, 1)), grid if height < width else grid * (height / max(width, 1))
    for axis, (count, page) in enumerate(zip(cells, (width, height), strict=True)):
        b[:, axis::2] = ((b[:, axis::2] - origin[axis]) * count // max(page, 1)).astype(np.int64)
    return np.maximum(b, 0)


def _parts(sums: np.ndarray, xs: np.ndarray, ys: np.ndarray, area: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """The areas (in strips) before, in and behind the run where an area is cut; none if it is not."""
    x0, y0, x1, y1 = area
    wide, high = xs[x0 : x1 + 1], ys[y0 : y1 + 1]
    down, right = sums[y0 : y1 + 1, x1] - sums[y0 : y1 + 1, x0], sums[y1, x0 : x1 + 1] - sums[y0, x0 : x1 + 1]
    wide, high, down, right = (a[1:] - a[:-1] for a in (wide, high, down, right))
    xb, xe, x_weight = lightest_run((right // wide).tolist(), wide.tolist())
    yb, ye, y_weight = lightest_run((down // high).tolist(), high.tolist())
    if xe - xb == x1 - x0 and ye - yb == y1 - y0:
        return []
    if x_weight > y_weight or (x_weight == y_weight and wide[xb:xe].sum() >= high[yb:ye].sum()):
        cut = [(a, y0, b, y1) for a, b in ((x0, x0 + xb), (x0 + xb, x0 + xe), (x0 + xe, x1))]
    else:
        cut = [(x0, a, x1, b) for a, b in ((y0, y0 + yb), (y0 + yb, y0 + ye), (y0 + ye, y1))]
    return [c for c in cut if c[0] < c[2] and c[1] < c[3] and c != area]


def _likeness(box: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """How much of a box and of each leaf is shared; sizes are those from one's beginning to the other's end."""
    sides = np.minimum(box[2:], leaves[:, 2:]) - np.maximum(box[:2], leaves[:, :2]) + 1
    shared = np.maximum(0, sides).prod(axis=1)
    spans = (box[2:] - leaves[:, :2] + 1).prod(axis=1) + (leaves[:, 2:] - box[:2] + 1).prod(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return shared / (spans - shared)


def mesh_ranks(boxes: np.ndarray, grid: float | None = None, scale: float = 1.0) -> np.ndarray:
    """The rank of each box (x1, y1, x2, y2, whole numbers) in reading order.

    The page is cut recursively at the lightest run across either axis, the wider of two as light. Each box goes to the
    leaf it is most like. Parts are read from the top, and from the left, or from the right where most of what they
    hold is taller than wide; so are the boxes of a leaf.
    """
    if not len(boxes):
        return np.zeros(0, np.int64)
    b = on_mesh(np.asarray(boxes), grid if grid is not None else 100 * np.sqrt(len(boxes)), scale)
    # what is covered changes at the boxes' edges only, so strips between them stand for the cells
    xs, ys = (np.unique(np.concatenate((b[:, axis], b[:, axis + 2], [0, b[:, axis + 2].max() + 1]))) for axis in (0, 1))
    at = np.stack([np.searchsorted(xs, b[:, 0]), np.searchsorted(ys, b[:, 1]), np.searchsorted(xs, b[:, 2]), np.searchsorted(ys, b[:, 3])], axis=1)
    covered = np.zeros((len(ys) - 1, len(xs) - 1), np.int64)
    for x1, y1, x2, y2 in at:
        covered[y1:y2, x1:x2] = 1
    sums = np.zeros((len(ys), len(xs)), np.int64)
    sums[1:, 1:] = (covered * np.diff(ys)[:, None] * np.diff(xs)).cumsum(axis=0).cumsum(axis=1)
    areas, parent = [(0, 0, len(xs) - 1, len(ys) - 1)], [-1]
    parts: list[list[int]] = []
    for node, area in enumerate(areas):  # grows as areas are cut
        parts.append([])
        for part in _parts(sums, xs, ys, area):
            parts[node].append(len(areas))
            areas.append(part)
            parent.append(node)
    # leaves in the order of reading from the top and the left
    leaves, todo = [], [0]
    while todo:
        node = todo.pop()
        todo += parts[node][::-1]
        if not parts[node]:
            leaves.append(node)
    places = np.array([[xs[x0], ys[y0], xs[x1], ys[y1]] for x0, y0, x1, y1 in (areas[n] for n in leaves)])
    held: list[list[int]] = [[] for _ in areas]
    for i, box in enumerate(b):
        held[leaves[int(np.nanargmax(_likeness(box, places)))]].append(i)
    tall = (b[:, 2] - b[:, 0]) < (b[:, 3] - b[:, 1])
    count, upright = np.array([len(h) for h in held]), np.array([int(tall[h].sum()) for h in held])
    for node in range(len(areas) - 1, 0, -1):  # parts come behind what they are cut from
        count[parent[node]] += count[node]
        upright[parent[node]] += upright[node]
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        from_right = count[node] < 2 * upright[node]
        mine = np.array(held[node], np.int64)
        order += mine[np.lexsort((b[mine, 1], -b[mine, 0]) if from_right else (b[mine, 0], b[mine, 1]))].tolist() if len(mine) > 1 else mine.tolist()
        across = all(areas[p][1::2] == areas[node][1::2] for p in parts[node])
        todo += parts[node] if across and from_right else parts[node][::-1]
    ranks = np.empty(len(b), np.int64)
    ranks[order] = np.arange(len(b))
    return ranks
