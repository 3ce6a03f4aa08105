"""Dense numeric kernels on one raster: NumPy only, no Spark.

With eight neighbours a raster row is coupled to the rows beside it alone, so the
Laplacian is block tridiagonal with blocks as wide as the raster; one sweep of block
elimination solves it exactly for any number of right-hand sides. Its work grows with
rows * columns ** 3 and its memory with rows * columns ** 2, so wider rasters go to
conjugate gradients under a multigrid cycle, linear in both.
"""

from __future__ import annotations

import numpy as np

from .multigrid import Multigrid, Operator

#: Columns up to which the elimination is the faster one, and the residual that the other is carried to.
DIRECT_WIDTH, EXACT = 128, 1e-11

STEPS = ((0, 1, False), (1, 0, False), (1, 1, True), (1, -1, True))


def conductances(resistance: np.ndarray, valid: np.ndarray, four: bool = False) -> dict[tuple[int, int], np.ndarray]:
    """Conductance from each cell to its neighbour in four directions (0 where there is none)."""
    h, w = resistance.shape
    g = np.where(valid, 1.0 / np.where(valid, resistance, 1.0), 0.0)
    out = {}
    for dr, dc, diagonal in STEPS[: 2 if four else 4]:
        c = np.zeros((h, w))
        a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        b = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
        both = valid[a] & valid[b]
        c[a] = np.where(both, (g[a] + g[b]) / 2, 0.0) / (np.sqrt(2.0) if diagonal else 1.0)
        out[dr, dc] = c
    return out


def apply_laplacian(cond: dict, v: np.ndarray) -> np.ndarray:
    """Net current out of every cell."""
    out = np.zeros_like(v)
    for a, b, i in _edge_currents(cond, v):
        out[a] += i
        out[b] -= i
    return out


def _edge_currents(cond: dict, v: np.ndarray):
    h, w = v.shape
    for (dr, dc), c in cond.items():
        a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        b = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
        yield a, b, c[a] * (v[a] - v[b])


def node_current(cond: dict, v: np.ndarray) -> np.ndarray:
    """The larger of inflow and outflow over the edges of each cell."""
    into, out = np.zeros_like(v), np.zeros_like(v)
    for a, b, i in _edge_currents(cond, v):
        p, n = np.maximum(i, 0), np.maximum(-i, 0)
        out[a] += p
        into[b] += p
        out[b] += n
        into[a] += n
    return np.maximum(into, out)


def labels(valid: np.ndarray, four: bool = False) -> np.ndarray:
    """Components of valid cells, 0 the largest (ties: the one met first), -1 elsewhere."""
    h, w = valid.shape
    mark = np.where(valid, np.arange(h * w).reshape(h, w), h * w)
    while True:
        low = mark.copy()
        for dr, dc, _ in STEPS[: 2 if four else 4]:
            a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
            b = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
            both = valid[a] & valid[b]
            m = np.minimum(low[a], low[b])
            low[a] = np.where(both, m, low[a])
            low[b] = np.where(both, np.minimum(m, low[b]), low[b])
        flat = low.ravel()
        jump = np.append(flat, h * w)
        low = jump[jump[flat]].reshape(h, w)
        low = np.where(valid, np.minimum(low, mark), h * w)
        if (low == mark).all():
            break
        mark = low
    roots, size = np.unique(mark[valid], return_counts=True)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    out = np.full((h, w), -1)
    out[valid] = place[np.searchsorted(roots, mark[valid])]
    return out


def _system(cond: dict, free: np.ndarray) -> tuple[np.ndarray, dict]:
    """Diagonal (1 where a cell is not free) and links between free cells, on whole grids."""
    h, w = free.shape
    degree, links = np.zeros((h, w)), {}
    for (dr, dc), c in cond.items():
        a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        b = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
        degree[a] += c[a]
        degree[b] += c[a]
        links[dr, dc] = np.zeros((h, w))
        links[dr, dc][a] = np.where(free[a] & free[b], c[a], 0.0)
    return np.where(free & (degree > 0), degree, 1.0), links


class Solver:
    """L v = rhs on active cells with v = ``held`` on ``fixed`` ones; one preparation for any number of right-hand sides.

    Cells that are neither are 0. The fixed cells must reach every active component,
    else the system is singular. ``method``: ``direct``, ``multigrid`` or by the width.
    """

    def __init__(self, cond: dict, active: np.ndarray, fixed: np.ndarray | None = None, method: str | None = None):
        self.cond, self.shape = cond, active.shape
        self.fixed = np.zeros(self.shape, bool) if fixed is None else fixed
        self.free = active & ~self.fixed
        self.diagonal, self.links = _system(cond, self.free)
        self.method = method or ("direct" if min(self.shape) <= DIRECT_WIDTH else "multigrid")
        h, w = self.shape
        near = {(dr, dc): np.ascontiguousarray(g[: h - dr, max(0, -dc) : w - max(0, dc)]) for (dr, dc), g in self.links.items()}
        self.operator = Operator(self.diagonal, near)
        self.cycle = Multigrid(self.diagonal, near) if self.method == "multigrid" else None

    def __call__(self, rhs: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
        """Voltages (k, H, W) for ``rhs`` (k, H, W)."""
        start = np.where(self.fixed, 0.0 if held is None else held, 0.0)
        b = np.where(self.free, rhs - apply_laplacian(self.cond, start), 0.0)
        if self.method == "direct":
            # The elimination goes along the shorter side.
            turn = self.shape[1] > self.shape[0]
            links = {(dc, dr) if (dr, dc) != (1, -1) else (1, -1): _turned(g, (dr, dc)) for (dr, dc), g in self.links.items()} if turn else self.links
            v = _eliminated(self.diagonal.T if turn else self.diagonal, links, b.transpose(0, 2, 1) if turn else b)
            v = v.transpose(0, 2, 1) if turn else v
        else:
            v = np.stack([iterate(self.operator, self.cycle, x, (EXACT,))[0] for x in b])
        return np.where(self.free, v, start)


def _turned(g: np.ndarray, step: tuple[int, int]) -> np.ndarray:
    """A link grid of the transposed raster; the falling diagonal is then seen from its other end."""
    out = g.T
    if step == (1, -1):
        back = np.zeros_like(out)
        back[:-1, 1:] = out[1:, :-1]
        return back
    return out


def solve(cond: dict, active: np.ndarray, rhs: np.ndarray, fixed: np.ndarray | None = None, held: np.ndarray | None = None) -> np.ndarray:
    return Solver(cond, active, fixed)(rhs, held)


def _eliminated(diagonal: np.ndarray, side: dict, b: np.ndarray) -> np.ndarray:
    """Block elimination, row by row, of all right-hand sides."""
    _, h, w = b.shape
    cols = np.arange(w)

    def own(r):
        m = np.diag(diagonal[r])
        e = side[0, 1][r, :-1]
        m[cols[:-1], cols[1:]] -= e
        m[cols[1:], cols[:-1]] -= e
        return m

    def down(r):
        m = np.diag(-side[1, 0][r])
        if (1, 1) in side:
            m[cols[:-1], cols[1:]] -= side[1, 1][r, :-1]
            m[cols[1:], cols[:-1]] -= side[1, -1][r, 1:]
        return m

    s, y, u = own(0), [b[:, 0, :].T], []
    for r in range(1, h):
        c = down(r - 1)
        both = np.linalg.solve(s, np.c_[c, y[-1]])
        u.append((both[:, :w], both[:, w:]))
        s = own(r) - c.T @ both[:, :w]
        y.append(b[:, r, :].T - c.T @ both[:, w:])
    x = [np.linalg.solve(s, y[-1])]
    for r in range(h - 2, -1, -1):
        m, z = u[r]
        x.append(z - m @ x[-1])
    return np.stack(x[::-1]).transpose(2, 0, 1)


def iterate(op, inverse, b: np.ndarray, targets: tuple[float, ...], start: np.ndarray | None = None, most: int = 20_000):
    """Conjugate gradients; ``inverse`` maps a residual to a step. Returns the solution and {target: iterations}, loosest first.

    The step's direction is corrected for an inverse that is not quite symmetric. Stops
    at the tightest target, or where rounding lets the residual fall no more.
    """
    size = np.linalg.norm(b)
    x = np.zeros(b.shape) if start is None else start.copy()
    done: dict[float, int] = {}
    todo = sorted(targets, reverse=True)
    if size == 0:
        return x, dict.fromkeys(todo, 0)
    r = b - op(x) if start is not None else b.copy()
    z = inverse(r)
    p, rz, best, since = z.copy(), (r * z).sum(), np.inf, 0
    for n in range(most + 1):
        now = np.linalg.norm(r)
        while todo and now <= todo[0] * size:
            done[todo.pop(0)] = n
        best, since = (now, 0) if now < 0.999 * best else (best, since + 1)
        if not todo or since > 300:
            break
        q = op(p)
        alpha = rz / (p * q).sum()
        x += alpha * p
        before = r
        r = r - alpha * q
        z = inverse(r)
        new = (r * z).sum()
        p = z + ((new - (before * z).sum()) / rz) * p
        rz = new
    return x, done


def conjugate_gradient(cond: dict, active: np.ndarray, rhs: np.ndarray, ground: np.ndarray, targets: tuple[float, ...] = (1e-6,), start: np.ndarray | None = None, most: int = 20_000, multigrid: bool = True):
    """Preconditioned conjugate gradients, by a multigrid cycle or the diagonal; returns voltages and {target: iterations}."""
    free = active & ~ground
    if not np.where(free, rhs, 0.0).any():
        raise ValueError("no injected current")
    solver = Solver(cond, active, ground, "multigrid" if multigrid else "diagonal")
    return iterate(solver.operator, solver.cycle or (lambda r: r / solver.diagonal), np.where(free, rhs, 0.0), targets, None if start is None else np.where(free, start, 0.0), most)


def residual(cond: dict, active: np.ndarray, v: np.ndarray, rhs: np.ndarray, ground: np.ndarray, region: np.ndarray | None = None) -> float:
    """|L v - b| / |b| over free cells; a short-circuited region counts as one row."""
    d = np.where(active, apply_laplacian(cond, v) - rhs, 0.0)
    keep = active & ~ground
    if region is not None:
        keep &= ~region
        top = np.sqrt((d[keep] ** 2).sum() + d[region].sum() ** 2)
        size = np.sqrt((rhs[keep] ** 2).sum() + rhs[region].sum() ** 2)
    else:
        top, size = np.linalg.norm(d[keep]), np.linalg.norm(rhs[keep])
    return float(top / size) if size > 0 else float("nan")


def pairwise(resistance: np.ndarray, valid: np.ndarray, focal: np.ndarray, four: bool = False) -> dict:
    """All pairs of focal labels i < j: i grounded, one ampere into j, v at j the effective resistance.

    Points share one factorization (the first is grounded, others superpose); regions are
    solved as two held sets, scaled to one ampere. Labels of different components are
    isolated: their resistance is -1.
    """
    cond, lab = conductances(resistance, valid, four), labels(valid, four)
    ids = [int(x) for x in np.unique(focal[focal > 0])]
    cells = {i: (focal == i) & valid for i in ids}
    home = {i: (set(lab[cells[i]].tolist()) if cells[i].any() else {-1}) for i in ids}
    reff = np.zeros((len(ids), len(ids)))
    voltages, currents, pairs, worst = {}, {}, [], 0.0
    points = all(c.sum() == 1 for c in cells.values())
    green: dict[int, np.ndarray] = {}
    if points:
        for g in {min(h) for h in home.values()} - {-1}:
            mine = [i for i in ids if home[i] == {g}]
            rhs = np.stack([cells[i].astype(float) for i in mine[1:]]) if len(mine) > 1 else None
            green[mine[0]] = np.zeros(valid.shape)
            if rhs is not None:
                green |= dict(zip(mine[1:], solve(cond, lab == g, rhs, cells[mine[0]]), strict=True))
    for a, i in enumerate(ids):
        for b in range(a + 1, len(ids)):
            j = ids[b]
            if home[i] != home[j] or len(home[i]) != 1 or home[i] == {-1}:
                reff[a, b] = reff[b, a] = -1
                continue
            active = lab == min(home[i])
            if points:
                v = green[j] - green[i]
                v = np.where(active, v - v[cells[i]][0], 0.0)
            else:
                v = solve(cond, active, np.zeros((1, *valid.shape)), cells[i] | cells[j], cells[j].astype(float))[0]
                v = v / apply_laplacian(cond, v)[cells[j]].sum()
            inject = cells[j] / cells[j].sum()
            worst = max(worst, residual(cond, active, v, inject, cells[i], cells[j] if cells[j].sum() > 1 else None))
            reff[a, b] = reff[b, a] = v[cells[j]].mean()
            c = node_current(cond, v)
            for s in (cells[i], cells[j]):
                c = np.where(s, np.maximum(c, 1.0 if s.sum() == 1 else 0.0), c)
            voltages[i, j], currents[i, j] = v, c
            pairs.append((i, j))
    total = sum(currents.values()) if currents else np.zeros(valid.shape)
    return {"labels": ids, "reff": reff, "pairs": pairs, "voltage": voltages, "current": currents, "cumulative": total, "residual": worst}


def advanced(resistance: np.ndarray, valid: np.ndarray, source: np.ndarray, ground: np.ndarray, four: bool = False) -> dict:
    """Currents from a source raster into ideal grounds; components without a ground stay at 0."""
    cond, lab = conductances(resistance, valid, four), labels(valid, four)
    fed = [g for g in range(lab.max() + 1) if (ground & (lab == g)).any()]
    active = np.isin(lab, fed) & valid
    rhs = np.where(active, source, 0.0)
    v = solve(cond, active, rhs[None], ground & active)[0]
    return {"voltage": v, "current": node_current(cond, v), "residual": residual(cond, active, v, rhs, ground & active)}


def moving_window(resistance: np.ndarray, valid: np.ndarray, source: np.ndarray, radius: int, block: int = 1, threshold: float = 0.0, targets: np.ndarray | None = None) -> dict:
    """Every block centre with enough source is grounded in turn while sources within ``radius`` inject; maps add up."""
    h, w = resistance.shape
    out = {"cumulative": np.zeros((h, w)), "potential": np.zeros((h, w))}
    half = block // 2
    for r0 in range(half, h, block):
        for c0 in range(half, w, block):
            box = (slice(max(0, r0 - half), r0 + half + 1), slice(max(0, c0 - half), c0 + half + 1))
            strength = np.where(valid[box] & (source[box] > threshold), source[box], 0).sum()
            if not strength or not valid[r0, c0] or (targets is not None and not targets[r0, c0]):
                continue
            win = (slice(max(0, r0 - radius), min(h, r0 + radius + 1)), slice(max(0, c0 - radius), min(w, c0 + radius + 1)))
            rr, cc = np.mgrid[win]
            inside = (rr - r0) ** 2 + (cc - c0) ** 2 <= radius**2
            target = (rr == r0) & (cc == c0)
            ok = valid[win] & inside
            s = np.where(ok & (source[win] > threshold) & ~target, source[win], 0.0)
            if s.sum() <= 0:
                continue
            s = s / s.sum() * strength
            for name, res in (("cumulative", resistance[win]), ("potential", np.ones(ok.shape))):
                lab = labels(ok)
                active = lab == lab[target][0]
                cond = conductances(res, ok)
                v = solve(cond, active, np.where(active, s, 0.0)[None], target)[0]
                out[name][win] += node_current(cond, v)
    flow = out["potential"]
    out["normalized"] = np.where(flow > 0, out["cumulative"] / np.where(flow > 0, flow, 1), 0.0)
    return out


def moving_windows(resistance: np.ndarray, valid: np.ndarray, source: np.ndarray, radius: int, block: int = 1, threshold: float = 0.0) -> dict:
    """``moving_window`` of many rasters of one shape (n, H, W): a target's windows in all of them are one dense solve.

    For small radii, as the systems grow with the window's cells squared.
    """
    n, h, w = resistance.shape
    out = {"cumulative": np.zeros((n, h, w)), "potential": np.zeros((n, h, w))}
    inject = np.where(valid & (source > threshold), source, 0.0)
    half = block // 2
    for r0 in range(half, h, block):
        for c0 in range(half, w, block):
            strength = inject[:, max(0, r0 - half) : r0 + half + 1, max(0, c0 - half) : c0 + half + 1].sum((1, 2))
            rr, cc = np.mgrid[max(0, r0 - radius) : min(h, r0 + radius + 1), max(0, c0 - radius) : min(w, c0 + radius + 1)]
            inside = (rr - r0) ** 2 + (cc - c0) ** 2 <= radius**2
            rr, cc = rr[inside], cc[inside]
            target = (rr == r0) & (cc == c0)
            s = np.where(target, 0.0, inject[:, rr, cc])
            on = np.flatnonzero((strength != 0) & valid[:, r0, c0] & ~(s.sum(1) <= 0))
            if not on.size:
                continue
            s = s[on] / s[on].sum(1, keepdims=True) * strength[on, None]
            at = on[:, None], rr, cc
            ok, links = valid[at], _disc_links(rr, cc)
            for name, res in (("cumulative", resistance[at]), ("potential", np.ones(ok.shape))):
                out[name][at] += _disc_current(res, ok, s, target, *links)
    flow = out["potential"]
    out["normalized"] = np.where(flow > 0, out["cumulative"] / np.where(flow > 0, flow, 1), 0.0)
    return out


def _disc_links(rr: np.ndarray, cc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours among listed cells: places of both ends, and the divisor for diagonals."""
    dr, dc = rr[None, :] - rr[:, None], cc[None, :] - cc[:, None]
    a, b = np.nonzero((dr >= 0) & (dr <= 1) & (np.abs(dc) <= 1) & ((dr == 1) | (dc == 1)))
    return a, b, np.where((dr[a, b] != 0) & (dc[a, b] != 0), np.sqrt(2.0), 1.0)


def _disc_current(res: np.ndarray, ok: np.ndarray, s: np.ndarray, target: np.ndarray, a: np.ndarray, b: np.ndarray, divisor: np.ndarray) -> np.ndarray:
    """Currents (n, cells) through the target's component with sources ``s`` and the target grounded."""
    n, m = ok.shape
    same = bool(ok.all() and (res == res[:1]).all())
    g = np.where(ok, 1.0 / np.where(ok, res, 1.0), 0.0)[: 1 if same else n]
    c = np.where((ok[:, a] & ok[:, b])[: len(g)], (g[:, a] + g[:, b]) / 2, 0.0) / divisor
    from_a, from_b = np.eye(m)[a], np.eye(m)[b]
    near = (from_a.T @ from_b) + (from_b.T @ from_a)
    active = np.broadcast_to(target, ok.shape)
    while True:
        more = active | (ok & ((active @ near) > 0))
        if (more == active).all():
            break
        active = more
    free = active & ~target
    degree = c @ (from_a + from_b)
    system = np.zeros((len(c), m, m))
    link = np.where((free[:, a] & free[:, b])[: len(c)], c, 0.0)
    system[:, a, b] = -link
    system[:, b, a] = -link
    cells = np.arange(m)
    system[:, cells, cells] = np.where(free[: len(c)] & (degree > 0), degree, 1.0)
    rhs = np.where(free, s, 0.0)
    v = np.linalg.solve(system[0], rhs.T).T if same else np.linalg.solve(system, rhs[..., None])[..., 0]
    v = np.where(free, v, 0.0)
    i = c * (v[:, a] - v[:, b])
    p, q = np.maximum(i, 0), np.maximum(-i, 0)
    return np.maximum(p @ from_a + q @ from_b, p @ from_b + q @ from_a)


# -- random fields ----------------------------------------------------------------


def rescaled(a: np.ndarray) -> np.ndarray:
    lo, hi = np.nanmin(a), np.nanmax(a)
    return (a - lo) / (hi - lo) if hi > lo else np.zeros_like(a, float)


def gaussian_field(shape, length: float, rng: np.random.Generator, stretch: float = 1.0, degrees: float = 0.0) -> np.ndarray:
    """White noise with a Gaussian covariance, rescaled to [0, 1].

    ``length`` is the correlation length along the principal axis, which stands
    ``degrees`` from the columns' direction; across it the length is ``stretch`` times
    smaller. The spectrum of a Gaussian is a Gaussian of the inverse lengths.
    """
    if length <= 0 or stretch < 1:
        raise ValueError("length must be positive and stretch at least 1")
    turn = np.exp(-1j * np.radians(degrees))
    wave = (np.fft.fftfreq(shape[1])[None, :] + 1j * np.fft.fftfreq(shape[0])[:, None]) * turn
    phase = (length * wave.real) ** 2 + (length / stretch * wave.imag) ** 2
    noise = np.fft.fft2(rng.standard_normal(shape)) * np.exp(-(np.pi**2) * phase)
    noise[0, 0] = 0  # the mean, beside which long waves would round away
    return rescaled(np.fft.ifft2(noise).real)


def midpoint_field(shape, roughness: float, rng: np.random.Generator) -> np.ndarray:
    """Random midpoint displacement on the next square of side 2**n + 1, cut to shape."""
    if not 0 < roughness < 1:
        raise ValueError("roughness must be in (0, 1)")
    n = 1 << int(np.ceil(np.log2(max(max(shape) - 1, 2))))
    a = np.zeros((n + 1, n + 1))
    a[:: n, :: n] = rng.standard_normal((2, 2))
    step, scale = n, 1.0
    while step > 1:
        half = step // 2
        mid = (a[:-1:step, :-1:step] + a[:-1:step, step::step] + a[step::step, :-1:step] + a[step::step, step::step]) / 4
        a[half::step, half::step] = mid + scale * rng.standard_normal(mid.shape)
        for r0, c0 in ((0, half), (half, 0)):
            rows, cols = np.arange(r0, n + 1, step), np.arange(c0, n + 1, step)
            total, count = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
            for dr, dc in ((-half, 0), (half, 0), (0, -half), (0, half)):
                r, c = rows + dr, cols + dc
                okr, okc = (r >= 0) & (r <= n), (c >= 0) & (c <= n)
                total[np.ix_(okr, okc)] += a[np.ix_(r[okr], c[okc])]
                count[np.ix_(okr, okc)] += 1
            a[np.ix_(rows, cols)] = total / count + scale * rng.standard_normal(total.shape)
        step, scale = half, scale * roughness
    return rescaled(a[: shape[0], : shape[1]])


def nearest_of(shape, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest of some seeds, ties to the first."""
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    best, at = np.full(shape, np.inf), np.zeros(shape, int)
    for k, (r, c) in enumerate(zip(rows, cols, strict=True)):
        d = (yy - r) ** 2 + (xx - c) ** 2
        at, best = np.where(d < best, k, at), np.minimum(d, best)
    return at, np.sqrt(best)


def cluster_field(shape, p: float, rng: np.random.Generator) -> np.ndarray:
    """Percolation clusters with random values; other cells take their nearest cluster's."""
    if not 0 < p <= 0.6:
        raise ValueError("p must be in (0, 0.6]")
    on = rng.random(shape) < p
    if not on.any():
        return np.zeros(shape)
    lab = labels(on)
    values = rng.random(lab.max() + 1)
    out = np.where(on, values[np.maximum(lab, 0)], np.nan)
    while np.isnan(out).any():
        padded = np.pad(out, 1, constant_values=np.nan)
        around = np.stack([padded[1 + dr : 1 + dr + shape[0], 1 + dc : 1 + dc + shape[1]] for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
        best = np.fmin.reduce(around)
        out = np.where(np.isnan(out), best, out)
    return rescaled(out)


def mosaic_field(shape, n: int, rng: np.random.Generator) -> np.ndarray:
    """Voronoi cells of random seeds with random values."""
    at, _ = nearest_of(shape, rng.integers(0, shape[0], n), rng.integers(0, shape[1], n))
    return rescaled(rng.random(n)[at])


def distance_field(shape, n: int, rng: np.random.Generator) -> np.ndarray:
    """Distance to the nearest of random seeds."""
    return rescaled(nearest_of(shape, rng.integers(0, shape[0], n), rng.integers(0, shape[1], n))[1])


def ramp(shape, degrees: float) -> np.ndarray:
    """Rows and columns combined along a direction, rescaled."""
    t = np.radians(degrees)
    return rescaled(np.add.outer(np.arange(shape[0]) * np.cos(t), np.arange(shape[1]) * np.sin(t)))


#: Generators by name: shape, random generator and their parameters by name.
FIELDS = {
    "grf": lambda s, r, length_scale=4.0, anisotropy=2.0, angle_deg=30.0: gaussian_field(s, length_scale, r, anisotropy, angle_deg),
    "fractal": lambda s, r, roughness=0.6: midpoint_field(s, roughness, r),
    "random_cluster": lambda s, r, p=0.4: cluster_field(s, p, r),
    "planar_gradient": lambda s, r, direction_deg=28.65: ramp(s, direction_deg),
    "edge_gradient": lambda s, r, direction_deg=28.65: 1 - np.abs(2 * ramp(s, direction_deg) - 1),
    "distance_gradient": lambda s, r, n_sources=4: distance_field(s, n_sources, r),
    "mosaic": lambda s, r, n_elements=12: mosaic_field(s, n_elements, r),
}


def field(name: str, shape, rng: int | np.random.Generator, **params) -> np.ndarray:
    """A named synthetic field in [0, 1]; the same seed and parameters give the same field."""
    if name not in FIELDS:
        raise KeyError(f"unknown generator {name}")
    if min(shape) < 4:
        raise ValueError("fields need at least 4 by 4 cells")
    return FIELDS[name](shape, np.random.default_rng(rng), **params)


def focal_points(resistance: np.ndarray, valid: np.ndarray, k: int, separation: int, rng: np.random.Generator, attempts: int = 200) -> list[tuple[int, int]]:
    """k cells of the largest component, mostly of low resistance, apart by ``separation`` (relaxed when rejected too often)."""
    lab = labels(valid)
    cells = np.argwhere(lab == 0)
    if len(cells) < k:
        raise ValueError("component smaller than the number of points")
    low = cells[resistance[cells[:, 0], cells[:, 1]] <= np.quantile(resistance[valid], 0.25)]
    low = low if len(low) else cells
    out: list[tuple[int, int]] = []
    failed = 0
    while len(out) < k:
        pool = cells if rng.random() < 0.3 else low
        r, c = (int(x) for x in pool[rng.integers(len(pool))])
        if (r, c) not in out and all(max(abs(r - a), abs(c - b)) >= separation for a, b in out):
            out.append((r, c))
            continue
        failed += 1
        if failed >= attempts:
            separation, failed = max(1, int(separation * 0.75)), 0
            if separation == 1:
                pool = [tuple(map(int, x)) for x in cells if tuple(map(int, x)) not in out]
                out.append(pool[rng.integers(len(pool))])
    return out


def outline(mask: np.ndarray) -> str:
    """The union of a mask's unit squares as WKT: rings traced along its border, holes after their shell."""
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    padded = np.pad(mask, 1)
    for r, c in np.argwhere(mask):
        r, c = int(r), int(c)
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if not padded[r + 1 + dr, c + 1 + dc]:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, came = [start], start, (1, 0)
        while True:
            nexts = edges[at]
            turn = max(nexts, key=lambda b: came[0] * (b[1] - at[1]) - came[1] * (b[0] - at[0]))
            nexts.remove(turn)
            if not nexts:
                del edges[at]
            came, at = (turn[0] - at[0], turn[1] - at[1]), turn
            ring.append(at)
            if at == start:
                break
        rings.append(ring)
    area = lambda g: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:], strict=False)) / 2
    shells = [g for g in rings if area(g) > 0]
    holes = [g for g in rings if area(g) < 0]
    text = lambda g: "(" + ", ".join(f"{x} {y}" for x, y in g) + ")"
    inside = lambda p, g: sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(g, g[1:], strict=False)) % 2
    parts = []
    for s in shells:
        mine = [h for h in holes if inside((min(h)[0] + 0.5, min(h)[1] + 0.5), s)]
        parts.append("(" + ", ".join(map(text, [s, *mine])) + ")")
    return "MULTIPOLYGON (" + ", ".join(parts) + ")" if len(parts) != 1 else "POLYGON " + parts[0]
