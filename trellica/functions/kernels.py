"""Cell recurrences that Spark has no expression for, as NumPy kernels over an Arrow batch of pairs.

A left dependency with a linear gap, h[j] = max(e[j], h[j-1] + g), is a running maximum of e[j] - g*j, so a kernel only
loops over rows and works on all pairs of a batch at once. Padding lies right of and below a pair's own cells and cannot
reach them. D consumes a query symbol, I a target symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np

NEG = -(10**9)


def padded(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in items], np.int64)
    out = np.zeros((len(items), max(int(size.max(initial=0)), 0)), np.uint8)
    for row, x in zip(out, items, strict=True):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    return out, size


def bunches(pairs: list[tuple], cells: int = 4_000_000) -> Iterator[np.ndarray]:
    """Row numbers of pairs of similar length, so that padding is small and a bunch's rows stay within `cells`."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (len(pairs[order[to]][1]) + 1) * 8 <= cells and len(pairs[order[to]][1]) <= 2 * len(pairs[order[at]][1]) + 16:
            to += 1
        yield np.array(order[at:to])
        at = to


def row_gains(q: np.ndarray, t: np.ndarray, table: np.ndarray) -> Callable[[int], np.ndarray]:
    """Scores of the symbols that row i (from 1) of a batch of tables pairs; one flat index is quicker than two."""
    flat, first, second = table.reshape(-1), q.astype(np.int64) * table.shape[1], t.astype(np.int64)
    return lambda i: flat.take(first[:, i - 1, None] + second, mode="wrap")


def global_scores(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap: int, free: bool = False) -> np.ndarray:
    """Columns score, target start, target end: global alignment, or with `free` the query against any target interval.

    The end is the leftmost best column; equal candidates carry the start of left before up before diagonal.
    """
    out = np.zeros((len(pairs), 3), np.int64)
    for pick in bunches(pairs):
        (q, n), (t, m) = padded([pairs[i][0] for i in pick]), padded([pairs[i][1] for i in pick])
        column = np.arange(t.shape[1] + 1)
        step = gap * column
        gains = row_gains(q, t, table)
        h = np.tile(step * 0 if free else step, (len(pick), 1)).astype(np.int64)
        start = np.tile(column if free else column * 0, (len(pick), 1))
        for i in range(q.shape[1] + 1):
            if i:
                diagonal, e = h[:, :-1] + gains(i), h + gap
                if free:
                    carried = start.copy()
                    carried[:, 1:] = np.where(diagonal > e[:, 1:], start[:, :-1], start[:, 1:])
                np.maximum(e[:, 1:], diagonal, out=e[:, 1:])
                flat = e - step
                run = np.maximum.accumulate(flat, axis=1)
                h = run + step
                if free:
                    fresh = np.ones_like(flat, bool)
                    fresh[:, 1:] = flat[:, 1:] > run[:, :-1]
                    start = np.take_along_axis(carried, np.maximum.accumulate(np.where(fresh, column, 0), axis=1), 1)
            for b in np.flatnonzero(n == i):
                end = int(np.argmax(h[b, : m[b] + 1])) if free else m[b]
                out[pick[b]] = h[b, end], start[b, end], end
    return out


def local_scores(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap: int) -> np.ndarray:
    """Columns score, query start, query end, target start, target end of the best local alignment.

    The best cell is the first in row order; starts follow left before up before diagonal; score 0 has all ends 0.
    """
    out = np.zeros((len(pairs), 5), np.int64)
    for pick in bunches(pairs):
        (q, n), (t, m) = padded([pairs[i][0] for i in pick]), padded([pairs[i][1] for i in pick])
        column = np.arange(t.shape[1] + 1)
        width, step, rows = len(column), gap * column, np.arange(len(pick))
        h = np.zeros((len(pick), width), np.int64)
        start = np.tile(column, (len(pick), 1))
        for i in range(1, q.shape[1] + 1):
            diagonal, up = h[:, :-1] + table[q[:, i - 1, None], t], h[:, 1:] + gap
            e, own = np.zeros_like(h), np.tile(i * width + column, (len(pick), 1))
            best = np.maximum(diagonal, up)
            e[:, 1:] = np.maximum(best, 0)
            own[:, 1:] = np.where(best > 0, np.where(diagonal > up, start[:, :-1], start[:, 1:]), own[:, 1:])
            flat = e - step
            run = np.maximum.accumulate(flat, axis=1)
            fresh = np.ones_like(flat, bool)
            fresh[:, 1:] = (flat[:, 1:] > run[:, :-1]) | ((e[:, 1:] == 0) & (flat[:, 1:] >= run[:, :-1]))
            h = run + step
            start = np.take_along_axis(own, np.maximum.accumulate(np.where(fresh, column, 0), axis=1), 1)
            seen = np.where((column <= m[:, None]) & (i <= n[:, None]), h, -1)
            at = np.argmax(seen, axis=1)
            value = seen[rows, at]
            for b in np.flatnonzero(value > out[pick, 0]):
                row, col = divmod(int(start[b, at[b]]), width)
                out[pick[b]] = value[b], row, i, col, at[b]
    return out


def affine_scores(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap_open: int, gap_extend: int, band: int | None = None) -> np.ndarray:
    """Global score with gaps of cost open + length * extend and no direct change between the two kinds of gap.

    With a band only cells with |row - column| <= band count; NEG where the end is out of reach.
    """
    out = np.full(len(pairs), NEG, np.int64)
    for pick in bunches(pairs):
        (q, n), (t, m) = padded([pairs[i][0] for i in pick]), padded([pairs[i][1] for i in pick])
        for i, match, down, right in affine_rows(q, t, table, gap_open, gap_extend, band):
            for b in np.flatnonzero(n == i):
                out[pick[b]] = max(match[b, m[b]], down[b, m[b]], right[b, m[b]])
    return np.where(out > NEG // 2, out, NEG)


def affine_rows(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, band: int | None) -> Iterator[tuple]:
    column = np.arange(t.shape[1] + 1)
    step = gap_extend * column
    match = np.full((len(q), len(column)), NEG, np.int64)
    match[:, 0] = 0
    down = np.full_like(match, NEG)
    for i in range(q.shape[1] + 1):
        if i:
            best = np.maximum(np.maximum(match, down), right)
            down = np.maximum(match + gap_open, down) + gap_extend
            match = np.full_like(down, NEG)
            match[:, 1:] = best[:, :-1] + table[q[:, i - 1, None], t]
        if band is not None:
            off = np.abs(column - i) > band
            match[:, off], down[:, off] = NEG, NEG
        right = np.full_like(match, NEG)
        right[:, 1:] = np.maximum.accumulate(match - step, axis=1)[:, :-1] + gap_open + step[1:]
        if band is not None:
            right[:, off] = NEG
        yield i, match, down, right


def stacked(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Integer series as rows of one array, filled up on the right, with their lengths."""
    size = np.array([len(x) for x in series], np.int64)
    out = np.zeros((len(series), int(size.max(initial=0))), np.int64)
    for row, x in zip(out, series, strict=True):
        row[: len(x)] = x
    return out, size


def warp_rows(q: np.ndarray, t: np.ndarray) -> Iterator[np.ndarray]:
    """Costs of warping each prefix of q's rows onto every prefix of t's, row after row, for a batch of series."""
    row = None
    for i in range(q.shape[1]):
        cost = np.abs(q[:, i, None] - t)
        total = np.cumsum(cost, axis=1)
        if row is None:
            row = total
        else:
            enter = row.copy()
            enter[:, 1:] = np.minimum(row[:, 1:], row[:, :-1])
            row = np.minimum.accumulate(enter - (total - cost), axis=1) + total
        yield row


def warp_costs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Dynamic time warping cost of integer series under absolute differences, in two rows; none may be empty."""
    out = np.zeros(len(pairs), np.int64)
    for pick in bunches(pairs):
        (q, n), (t, m) = stacked([pairs[i][0] for i in pick]), stacked([pairs[i][1] for i in pick])
        for i, row in enumerate(warp_rows(q, t)):
            for b in np.flatnonzero(n == i + 1):
                out[pick[b]] = row[b, m[b] - 1]
    return out


#: Cells of a piece of two series that is walked back over its own costs; larger pieces are split.
WARP_CELLS = 4096


def warp_walks(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Cells (row, column) from 0 of optimal warping paths of short series; ties prefer diagonal, then up, then left."""
    out: list = [None] * len(pairs)
    for pick in bunches(pairs, 8 * WARP_CELLS):
        (q, n), (t, m) = stacked([pairs[i][0] for i in pick]), stacked([pairs[i][1] for i in pick])
        cost = np.full((len(pick), q.shape[1] + 1, t.shape[1] + 1), 2**60, np.int64)
        for i, row in enumerate(warp_rows(q, t)):
            cost[:, i + 1, 1:] = row
        cost[:, 0, 0] = -1  # the first cell ends every path
        at, i, j, steps = np.arange(len(pick)), n.copy(), m.copy(), []
        while i.any():
            steps.append(np.stack((i, j), axis=1))
            a, b = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            move = np.argmin(np.stack((cost[at, a, b], cost[at, a, j], cost[at, i, b])), axis=0)
            live = i > 0
            i, j = np.where(live & (move != 2), a, i), np.where(live & (move != 1), b, j)
        walked = np.stack(steps, axis=1)
        for k, p in enumerate(pick):
            own = walked[k]
            out[p] = own[own[:, 0] > 0][::-1] - 1
    return out


def warp_path(q: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    """Pieces of an optimal warping path in order, in memory linear in the lengths.

    The costs of both halves of the rows meet between two rows: the cheapest step there splits the path.
    """
    if len(q) * len(t) <= WARP_CELLS or len(q) == 1:
        return warp_walks([(q, t)])
    mid = len(q) // 2
    for ahead in warp_rows(q[None, :mid], t[None]):
        pass
    for back in warp_rows(q[None, mid:][:, ::-1], t[None, ::-1]):
        pass
    ahead, back = ahead[0], back[0, ::-1]
    straight, diagonal = ahead + back, ahead[:-1] + back[1:]
    slant = len(diagonal) > 0 and diagonal.min() <= straight.min()
    at = int(np.argmin(diagonal if slant else straight))
    to = at + 1 if slant else at
    return [*warp_path(q[:mid], t[: at + 1]), *[p + (mid, to) for p in warp_path(q[mid:], t[to:])]]


def warp_paths(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Optimal warping paths as cells (row, column) counted from 1, the first being (0, 0)."""
    short = [k for k, (q, t) in enumerate(pairs) if len(q) * len(t) <= WARP_CELLS]
    found = dict(zip(short, warp_walks([pairs[k] for k in short]), strict=True))
    return [np.concatenate((np.zeros((1, 2), np.int64), 1 + (found[k] if k in found else np.concatenate(warp_path(q, t))))) for k, (q, t) in enumerate(pairs)]


def runs(ops: str) -> str:
    """Run-length operation string."""
    return "".join(f"{len(list(g))}{op}" for op, g in groupby(ops))


def linear_table(pair: np.ndarray, gap: int) -> np.ndarray:
    height, width = pair.shape
    step = gap * np.arange(width + 1)
    h = np.empty((height + 1, width + 1), np.int64)
    h[0] = step
    for i in range(1, height + 1):
        e = h[i - 1] + gap
        e[1:] = np.maximum(e[1:], h[i - 1, :-1] + pair[i - 1])
        h[i] = np.maximum.accumulate(e - step) + step
    return h


#: Cells up to which a table is filled by plain Python, and up to which whole tables replace repeated splitting.
SMALL, WHOLE = 400, 4_000_000


def small_table(pair: list[list[int]], width: int, gap: int) -> list[list[int]]:
    h = [[gap * j for j in range(width + 1)]]
    for scores in pair:
        above, row = h[-1], [h[-1][0] + gap]
        for j, score in enumerate(scores):
            row.append(max(above[j] + score, above[j + 1] + gap, row[j] + gap))
        h.append(row)
    return h


def leftmost_columns(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap: int) -> list[int]:
    """For every row edge the smallest column at which an optimal global path can cross it.

    Optimal paths cannot pass one another without meeting, so one path crosses all edges leftmost; these are the columns
    at which repeated splitting, leftmost column first, cuts.
    """
    pair = table[q[:, None], t[None, :]]
    ahead, back = linear_table(pair, gap), linear_table(pair[::-1, ::-1], gap)[::-1, ::-1]
    best = ahead + back == ahead[-1, -1]
    columns, at = [0], 0
    for i in range(len(q)):
        while True:
            if best[i + 1, at] and ahead[i, at] + gap == ahead[i + 1, at]:
                break
            if at < len(t) and best[i + 1, at + 1] and ahead[i, at] + pair[i, at] == ahead[i + 1, at + 1]:
                at += 1
                break
            at += 1
        columns.append(at)
    return columns


def walk_linear(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap: int) -> str:
    """One optimal global path of a piece, preferring diagonal, then up, then left on the way back."""
    pair = table[q[:, None], t[None, :]]
    h = linear_table(pair, gap).tolist() if pair.size > SMALL else small_table(pair.tolist(), len(t), gap)
    pair, same = pair.tolist(), (q[:, None] == t[None, :]).tolist()
    i, j, ops = len(q), len(t), []
    while i or j:
        if i and j and h[i][j] == h[i - 1][j - 1] + pair[i - 1][j - 1]:
            i, j = i - 1, j - 1
            ops.append("=" if same[i][j] else "X")
        elif i and h[i][j] == h[i - 1][j] + gap:
            i -= 1
            ops.append("D")
        else:
            j -= 1
            ops.append("I")
    return "".join(reversed(ops))


def last_row(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap: int) -> np.ndarray:
    step = gap * np.arange(len(t) + 1)
    h = step.astype(np.int64)
    for c in q:
        e = h + gap
        e[1:] = np.maximum(e[1:], h[:-1] + table[c, t])
        h = np.maximum.accumulate(e - step) + step
    return h


def trace_linear(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap: int, block: int, box: tuple[int, int, int, int]) -> str:
    """Operations of an optimal path through box (row, column, row, column), in memory of one block of rows.

    Rows are cut into blocks of `block` (0: one block). A range of blocks is split at its middle block's edge, at the
    leftmost column where the best scores from both sides meet; a single block is walked back. Where whole tables fit,
    all split columns are read off at once.
    """
    edges = list(range(0, len(q), block)) + [len(q)] if block and len(q) else [0, len(q)]

    def go(lo: int, hi: int, a: int, p: int, b: int, c: int) -> str:
        while hi - lo > 1:
            mid = lo + (hi - lo) // 2
            row = edges[mid]
            if row <= a:
                lo = mid
            elif row >= b:
                hi = mid
            else:
                meet = last_row(q[a:row], t[p:c], table, gap) + last_row(q[row:b][::-1], t[p:c][::-1], table, gap)[::-1]
                at = p + int(np.argmax(meet))
                return go(lo, mid, a, p, row, at) + go(mid, hi, row, at, b, c)
        return walk_linear(q[a:b], t[p:c], table, gap)

    a, p, b, c = box
    inner = [e for e in edges if a < e < b]
    if not inner or (b - a) * (c - p) > WHOLE:
        return go(0, len(edges) - 1, *box)
    columns = leftmost_columns(q[a:b], t[p:c], table, gap)
    stops = [(a, p), *[(e, p + columns[e - a]) for e in inner], (b, c)]
    return "".join(walk_linear(q[i:k], t[j:m], table, gap) for (i, j), (k, m) in zip(stops[:-1], stops[1:], strict=True))


#: Cells of a pair up to which its path is found together with those of other pairs, and of all pairs taken at once.
SHORT, TOGETHER = 1 << 14, 1 << 20
#: Steps of a path on the way back: how many rows and columns they leave behind.
DIAGONAL, UP, LEFT, STOP = 0, 1, 2, 3


def alike(pairs: list[tuple], cells: int) -> Iterator[np.ndarray]:
    """Row numbers of pairs whose tables are of similar height and width, so that padded ones stay within `cells`."""
    shape = [(len(q).bit_length(), len(t).bit_length()) for q, t in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (shape[k], len(pairs[k][0])))
    for (high, wide), same in groupby(order, key=lambda k: shape[k]):
        same, size = list(same), max(1, cells >> (high + wide))
        for at in range(0, len(same), size):
            yield np.array(same[at : at + size])


def last_steps(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap: int, edge: np.ndarray | None = None, columns: np.ndarray | None = None) -> np.ndarray:
    """Step by which an optimal path enters each cell (pair, row, column), for a batch of pairs.

    Without columns it is the leftmost one: left before diagonal before up. With columns, paths start anew at every row
    where `edge` is set, in its column there, and prefer diagonal, then up, then left.
    """
    column, gains = np.arange(t.shape[1] + 1), row_gains(q, t, table)
    step = gap * column
    out = np.full((len(q), q.shape[1] + 1, len(column)), LEFT, np.uint8)
    out[:, 0, 0], out[:, 1:, 0] = STOP, UP
    h = np.tile(step, (len(q), 1))
    for i in range(1, q.shape[1] + 1):
        diagonal, up = h[:, :-1] + gains(i), h + gap
        h = up.copy()
        np.maximum(h[:, 1:], diagonal, out=h[:, 1:])
        h -= step
        np.maximum.accumulate(h, axis=1, out=h)
        h += step
        slant = h[:, 1:] == diagonal
        if columns is None:
            left = h[:, 1:] == h[:, :-1] + gap
            out[:, i, 1:] = LEFT * left.view(np.uint8) + ~(left | slant)
            continue
        out[:, i, 1:] = (~slant).view(np.uint8) << (h[:, 1:] != up[:, 1:]).view(np.uint8)
        cut = np.flatnonzero(edge[:, i])
        if len(cut):
            beyond = column - columns[cut, i, None]
            out[cut, i] = np.where(beyond > 0, LEFT, out[cut, i])
            h[cut] = np.where(beyond >= 0, gap * beyond, -(2**60))
    return out


def walk_back(steps: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps, rows and columns (number of the step, pair) from the last cells (n, m) of all pairs to their first ones."""
    _, height, width = steps.shape
    flat, back = steps.reshape(-1), np.array([width + 1, width, 1, 0])
    first = np.arange(len(n)) * height * width
    at = first + n * width + m
    cells, moves = [], []
    while True:
        move = flat[at]
        if (move == STOP).all():
            break
        cells.append(at - first)
        moves.append(move)
        at = at - back[move]
    row, column = np.divmod(np.array(cells, np.int64).reshape(-1, len(n)), width)
    return np.array(moves, np.uint8).reshape(-1, len(n)), row, column


def run_strings(symbols: np.ndarray) -> list[str]:
    """Run-length operation string of each row of operation bytes, 0 standing for none."""
    pair, place = np.nonzero(symbols)
    ops = symbols[pair, place]
    new = np.ones(len(ops), bool)
    new[1:] = (ops[1:] != ops[:-1]) | (pair[1:] != pair[:-1])
    starts = np.flatnonzero(new)
    texts = [f"{n}{op}" for n, op in zip(np.diff(starts, append=len(ops)).tolist(), ops[starts].tobytes().decode(), strict=True)]
    ends = np.cumsum(np.bincount(pair[starts], minlength=len(symbols))).tolist()
    return ["".join(texts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def short_traces(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap: int, blocks: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Operation strings of short pairs of similar shape, as trace_linear() finds them, in two passes over all their tables.

    offsets: how many rows of the block in which a pair begins lie before it. The first pass finds the columns at which
    the leftmost paths leave the rows that blocks end with, the second the paths between them.
    """
    (q, n), (t, m) = padded([p[0] for p in pairs]), padded([p[1] for p in pairs])
    row = np.arange(q.shape[1] + 1)
    edge = ((row + offsets[:, None]) % blocks[:, None] == 0) & (row > 0) & (row < n[:, None])
    columns = np.zeros(edge.shape, np.int64)
    if edge.any():
        moves, rows, at = walk_back(last_steps(q, t, table, gap), n, m)
        step, pair = np.nonzero(moves < LEFT)
        columns[pair, rows[step, pair]] = at[step, pair]
    moves, rows, at = walk_back(last_steps(q, t, table, gap, edge, columns), n, m)
    symbols = np.frombuffer(b"XDI\0", np.uint8)[moves]
    step, pair = np.nonzero(moves == DIAGONAL)
    same = q[pair, rows[step, pair] - 1] == t[pair, at[step, pair] - 1]
    symbols[step[same], pair[same]] = ord("=")
    return run_strings(symbols[::-1].T)


def traces(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap: int, blocks: list[int], boxes: list[tuple[int, int, int, int]]) -> list[str]:
    """Operation strings of trace_linear() for many pairs: short ones together, longer ones one after the other."""
    out = [""] * len(pairs)
    inner = [(q[a:b], t[p:c]) for (q, t), (a, p, b, c) in zip(pairs, boxes, strict=True)]
    short = [k for k, (q, t) in enumerate(inner) if (len(q) + 1) * (len(t) + 1) <= SHORT]
    size = np.array([block or max(1, len(q)) for block, (q, _) in zip(blocks, pairs, strict=True)], np.int64)
    offset = np.array([box[0] for box in boxes], np.int64) % size
    for pick in alike([inner[k] for k in short], TOGETHER):
        own = [short[k] for k in pick]
        for k, ops in zip(own, short_traces([inner[k] for k in own], table, gap, size[own], offset[own]), strict=True):
            out[k] = ops
    for k in sorted(set(range(len(pairs))) - set(short)):
        q, t = (np.frombuffer(x, np.uint8) for x in pairs[k])
        out[k] = runs(trace_linear(q, t, table, gap, blocks[k], boxes[k]))
    return out


def affine_band(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, band: int) -> np.ndarray:
    """Scores (row, lane, offset) of the cells with |row - column| <= band; column = row + offset - band. Lanes: match, D, I."""
    n, m, width = len(q), len(t), 2 * band + 1
    out = np.full((n + 1, 3, width), NEG, np.int32)
    offset = np.arange(width)
    step = gap_extend * offset
    out[0, 0, band] = 0
    for i in range(n + 1):
        column = i + offset - band
        inside = (column >= 0) & (column <= m)
        match, down, right = out[i]
        if i:
            match[:] = out[i - 1].max(axis=0) + table[q[i - 1], t[np.clip(column - 1, 0, max(m - 1, 0))]] if m else NEG
            match[~inside | (column == 0)] = NEG
            down[:-1] = np.maximum(out[i - 1, 0, 1:] + gap_open, out[i - 1, 1, 1:]) + gap_extend
            down[~inside] = NEG
        right[1:] = np.maximum.accumulate(match - step)[:-1] + gap_open + step[1:]
        right[~inside] = NEG
        np.maximum(out[i], NEG, out=out[i])
    return out


def trace_affine(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, band: int | None) -> tuple[int, str] | None:
    """Score and operations of an optimal affine path within a band, None if it is out of reach; without a band affine_split().

    Memory is the query's length times the band; ties prefer match, then D, then I.
    """
    if band is None:
        return affine_split(q, t, table, gap_open, gap_extend)
    i, j = len(q), len(t)
    band = min(max(i, j), band)
    if abs(i - j) > band:
        return None
    lanes = affine_band(q, t, table, gap_open, gap_extend, band)
    state = int(np.argmax(lanes[i, :, j - i + band]))
    score = int(lanes[i, state, j - i + band])
    if score <= NEG // 2:
        return None
    ops, here = [], score
    change = {(1, 0): gap_open + gap_extend, (1, 1): gap_extend, (2, 0): gap_open + gap_extend, (2, 2): gap_extend}
    while i or j:
        pair = int(table[q[i - 1], t[j - 1]]) if state == 0 else 0
        i, j, was = i - (state != 2), j - (state != 1), state
        ops.append("DI"[was - 1] if was else "=" if q[i] == t[j] else "X")
        for state in (0, 1, 2):
            cost = pair if was == 0 else change.get((was, state))
            if cost is not None and abs(j - i) <= band and int(lanes[i, state, j - i + band]) + cost == here:
                break
        here = int(lanes[i, state, j - i + band])
    return score, "".join(reversed(ops))


#: Cells of a piece whose affine table is filled and walked back; larger pieces are split.
AFFINE_CELLS = 1 << 16


def affine_ahead(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, start: int) -> Iterator[np.ndarray]:
    """Rows (state, column) of the best scores from the first cell, entered in state `start` (match, D, I)."""
    step = gap_extend * np.arange(len(t) + 1)
    row = np.full((3, len(t) + 1), NEG, np.int64)
    row[start, 0] = 0
    row[2, 1:] = np.maximum(np.maximum.accumulate(row[0] - step)[:-1] + gap_open, row[2, 0]) + step[1:]
    yield row
    for c in q:
        new = np.full_like(row, NEG)
        new[0, 1:] = row.max(axis=0)[:-1] + table[c, t]
        new[1] = np.maximum(row[0] + gap_open, row[1]) + gap_extend
        new[2, 1:] = np.maximum.accumulate(new[0] - step)[:-1] + gap_open + step[1:]
        row = np.maximum(new, NEG)
        yield row


def affine_behind(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, ends: tuple[int, ...]) -> np.ndarray:
    """Scores (state, column) of the best way from each cell of the first row to the last cell, left in one of `ends`."""
    step = gap_extend * np.arange(len(t) + 1)
    row = np.full((3, len(t) + 1), NEG, np.int64)
    row[list(ends), -1] = 0
    row[2] = row[2, -1] + step[-1] - step
    row[0, :-1] = np.maximum(row[0, :-1], row[2, 1:] + gap_open + gap_extend)
    for c in q[::-1]:
        pair = np.full(len(t) + 1, NEG, np.int64)
        pair[:-1] = table[c, t] + row[0, 1:]
        new = np.empty_like(row)
        new[2] = np.maximum.accumulate((pair + step)[::-1])[::-1] - step
        new[1] = np.maximum(pair, row[1] + gap_extend)
        new[0] = np.maximum(pair, row[1] + gap_open + gap_extend)
        new[0, :-1] = np.maximum(new[0, :-1], new[2, 1:] + gap_open + gap_extend)
        row = np.maximum(new, NEG)
    return row


def affine_walk(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, start: int, ends: tuple[int, ...]) -> tuple[int, str]:
    """Score and operations of a piece from its whole table; ties prefer match, then D, then I."""
    rows = np.stack(list(affine_ahead(q, t, table, gap_open, gap_extend, start)))
    i, j = len(q), len(t)
    state = max(ends, key=lambda s: (rows[i, s, j], -s))
    score, ops = int(rows[i, state, j]), []
    while i or j:
        here = rows[i, state, j]
        i, j, was = i - (state != 2), j - (state != 1), state
        ops.append("DI"[was - 1] if was else "=" if q[i] == t[j] else "X")
        gains = (table[q[i], t[j]],) * 3 if was == 0 else tuple(gap_extend + (gap_open if s == 0 else 0) if s in (0, was) else None for s in (0, 1, 2))
        state = next(s for s in (0, 1, 2) if gains[s] is not None and rows[i, s, j] + gains[s] == here and rows[i, s, j] > NEG // 2)
    return score, "".join(reversed(ops))


def affine_split(q: np.ndarray, t: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, start: int = 0, ends: tuple[int, ...] = (0, 1, 2)) -> tuple[int, str]:
    """Score and operations of an optimal affine path in memory linear in both lengths.

    The best scores from both sides meet at the middle row; the column and the state of the gap in which they sum to the
    optimum are carried into both halves, so a gap across the cut is opened once.
    """
    if len(q) < 2 or len(q) * len(t) <= AFFINE_CELLS:
        return affine_walk(q, t, table, gap_open, gap_extend, start, ends)
    mid = len(q) // 2
    for row in affine_ahead(q[:mid], t, table, gap_open, gap_extend, start):
        pass
    meet = (row + affine_behind(q[mid:], t, table, gap_open, gap_extend, ends)).T
    at, state = divmod(int(np.argmax(meet)), 3)
    left = affine_split(q[:mid], t[:at], table, gap_open, gap_extend, start, (state,))[1]
    return int(meet[at, state]), left + affine_split(q[mid:], t[at:], table, gap_open, gap_extend, state, ends)[1]


def common_run(q: bytes, t: bytes, i: int, j: int) -> int:
    """How many symbols from q[i] and t[j] on are equal."""
    most, done, size = min(len(q) - i, len(t) - j), 0, 16
    if most <= 0 or q[i] != t[j]:
        return 0
    while done + size <= most and q[i + done : i + done + size] == t[j + done : j + done + size]:
        done += size
        size *= 2
    while size:
        if done + size <= most and q[i + done : i + done + size] == t[j + done : j + done + size]:
            done += size
        size //= 2
    return done


def trace_edits(q: bytes, t: bytes, most: int) -> tuple[int, str] | None:
    """Edit distance and operations if the distance is at most `most`, else None.

    For each number of edits the furthest row on every diagonal is kept (Ukkonen, 1985), so time grows with the square of
    the distance and the length of equal runs, not with the product of the lengths. Ties prefer X, then D, then I.
    """
    n, m = len(q), len(t)
    reach: list[dict[int, int]] = []
    for edits in range(most + 1):
        row = {}
        for k in range(-min(edits, n), min(edits, m) + 1):
            i = entry(reach[-1], k, n, m)[0] if reach else 0
            if i >= 0:
                row[k] = i + common_run(q, t, i, i + k)
        reach.append(row)
        if row.get(m - n, -1) == n:
            break
    else:
        return None
    ops, k, i = [], m - n, n
    for row in reach[-2::-1]:
        start, op = entry(row, k, n, m)
        ops.append((i - start, op))
        k, i = k + {"X": 0, "D": 1, "I": -1}[op], start - (op != "I")
    return len(reach) - 1, "=" * i + "".join(op + "=" * run for run, op in reversed(ops))


def entry(before: dict[int, int], k: int, n: int, m: int) -> tuple[int, str]:
    """Furthest row at which one more edit enters diagonal k, and that edit; -1 if none does."""
    best, op = -1, ""
    for kind, at, more in (("X", k, 1), ("D", k + 1, 1), ("I", k - 1, 0)):
        i = before.get(at, -2) + more
        if best < i <= n and 0 <= i + k <= m and before.get(at) is not None:
            best, op = i, kind
    return best, op


def lcs_bits(q: bytes, t: bytes) -> int:
    """Length of a longest common subsequence by one addition on whole-row bit vectors a query symbol."""
    place: dict[int, int] = {}
    for j, c in enumerate(t):
        place[c] = place.get(c, 0) | 1 << j
    full = (1 << len(t)) - 1
    row = full
    for c in q:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(t) - row.bit_count()


def second_scores(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap: int, free: bool = False, local: bool = False) -> np.ndarray:
    """Scores of linear-gap alignments by antidiagonals, a recurrence of its own for verification, for a batch of pairs."""
    out = np.zeros(len(pairs), np.int64)
    for pick in bunches(pairs):
        (q, n), (t, m) = padded([pairs[i][0] for i in pick]), padded([pairs[i][1] for i in pick])
        far = near = np.full((len(pick), q.shape[1] + 1), NEG, np.int64)
        best = np.full(len(pick), 0 if local else NEG, np.int64)
        for d, lo, hi, gain in antidiagonals(q, t, table):
            now = np.full_like(far, NEG)
            now[:, max(lo, 1) : min(hi, d - 1) + 1] = far[:, max(lo, 1) - 1 : max(min(hi, d - 1), 0)] + gain
            now[:, max(lo, 1) : hi + 1] = np.maximum(now[:, max(lo, 1) : hi + 1], near[:, max(lo, 1) - 1 : hi] + gap)
            now[:, lo : min(hi, d - 1) + 1] = np.maximum(now[:, lo : min(hi, d - 1) + 1], near[:, lo : min(hi, d - 1) + 1] + gap)
            if lo == 0:
                now[:, 0] = 0 if free or local else gap * d
            if local:
                i = np.arange(lo, hi + 1)
                now[:, lo : hi + 1] = np.maximum(now[:, lo : hi + 1], 0)
                best = np.maximum(best, np.where((i <= n[:, None]) & (d - i <= m[:, None]), now[:, lo : hi + 1], 0).max(axis=1))
            else:
                at = np.flatnonzero((d >= n) & (d - n <= m) if free else n + m == d)
                best[at] = np.maximum(best[at], now[at, n[at]])
            far, near = near, now
        out[pick] = best
    return out


def antidiagonals(q: np.ndarray, t: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """For each antidiagonal its number, first and last row, and the scores of the symbols that its inner cells pair."""
    for d in range(q.shape[1] + t.shape[1] + 1):
        lo, hi = max(0, d - t.shape[1]), min(q.shape[1], d)
        a, b = max(lo, 1), min(hi, d - 1)
        yield d, lo, hi, table[q[:, a - 1 : b], t[:, d - b - 1 : d - a][:, ::-1]] if a <= b else np.zeros((len(q), 0), np.int64)


def second_affine_scores(pairs: list[tuple[bytes, bytes]], table: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """Scores of global affine alignments by antidiagonals over three states, for verification."""
    out = np.zeros(len(pairs), np.int64)
    for pick in bunches(pairs):
        (q, n), (t, m) = padded([pairs[i][0] for i in pick]), padded([pairs[i][1] for i in pick])
        blank = np.full((3, len(pick), q.shape[1] + 1), NEG, np.int64)
        far = near = blank
        for d, lo, hi, gain in antidiagonals(q, t, table):
            now = blank.copy()
            up, left = slice(max(lo, 1), hi + 1), slice(lo, min(hi, d - 1) + 1)
            now[0, :, max(lo, 1) : min(hi, d - 1) + 1] = far[:, :, max(lo, 1) - 1 : max(min(hi, d - 1), 0)].max(axis=0) + gain
            now[1, :, up] = np.maximum(near[0, :, max(lo, 1) - 1 : hi] + gap_open, near[1, :, max(lo, 1) - 1 : hi]) + gap_extend
            now[2, :, left] = np.maximum(near[0, :, left] + gap_open, near[2, :, left]) + gap_extend
            if d == 0:
                now[0, :, 0] = 0
            at = np.flatnonzero(n + m == d)
            out[pick[at]] = now[:, at, n[at]].max(axis=0)
            far, near = near, now
    return out
