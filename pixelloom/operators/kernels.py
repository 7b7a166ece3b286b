"""Pixel kernels in numpy, for Arrow-batched stages.

Planes are uint8 arrays [y, x]; stencils, labels and edges take stacks [..., y, x] of them too. The long-form plans of operators/pixels.py define the
same stencils relationally; tests hold one against the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def gray(rgb: np.ndarray) -> np.ndarray:
    out = np.multiply(rgb[..., 0], 19595, dtype=np.uint32)
    out += np.multiply(rgb[..., 1], 38470, dtype=np.uint32)
    out += np.multiply(rgb[..., 2], 7471, dtype=np.uint32)
    return (out >> 16).astype(np.uint8)


def _smoothed(p: np.ndarray, axis: int) -> np.ndarray:
    """1, 2, 1 along an axis, without its first and last."""
    lo, mid, hi = (np.moveaxis(p, axis, -1)[..., i : p.shape[axis] - 2 + i] for i in range(3))
    out = lo + hi
    out += mid
    out += mid
    return np.moveaxis(out, -1, axis)


def gaussian(plane: np.ndarray) -> np.ndarray:
    out = plane.copy()
    if min(plane.shape[-2:]) > 2:
        out[..., 1:-1, 1:-1] = _smoothed(_smoothed(plane.astype(np.int16), -1), -2) >> 4
    return out


def sobel(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mag, turn = np.zeros_like(plane), np.zeros_like(plane)
    if min(plane.shape[-2:]) > 2:
        p = plane.astype(np.int16)
        gx = _smoothed(p[..., 2:] - p[..., :-2], -2)
        gy = _smoothed(p[..., 2:, :] - p[..., :-2, :], -1)
        ax, ay = np.abs(gx), np.abs(gy)
        mag[..., 1:-1, 1:-1] = np.minimum(255, ax + ay)
        zero, one, two, three = np.arange(4, dtype=np.uint8)
        slanted = np.where((gx ^ gy) >= 0, one, three)  # like signs, 0 among the positive
        turn[..., 1:-1, 1:-1] = np.where(ax >= ay << 1, zero, np.where(ay >= ax << 1, two, slanted))
    return mag, turn


def thin(mag: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Only ridges across their direction stay; of a plateau of two the one that comes second goes."""
    out = np.zeros_like(mag)
    if min(mag.shape[-2:]) > 2:
        width, flat = mag.shape[-1], mag.ravel()
        inner = np.zeros(mag.shape, bool)
        inner[..., 1:-1, 1:-1] = mag[..., 1:-1, 1:-1] > 0
        at = np.flatnonzero(inner)
        step = np.array([1, width + 1, width, 1 - width])[turn.ravel()[at]]  # along the gradient
        v = flat[at]
        keep = at[(v >= flat[at - step]) & (v > flat[at + step])]
        out.ravel()[keep] = flat[keep]
    return out


def row_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set pixels in raster order: row (counted through all planes of a stack), first and last x."""
    h, w = on.shape[-2:]
    wide = np.zeros((on.size // max(w, 1), w + 2), bool)
    wide[:, 1:-1] = on.reshape(-1, w)
    flat = wide.ravel()
    turns = np.flatnonzero(flat[1:] != flat[:-1])  # a row ends unset, so that beginnings and ends take turns
    begin, end = turns[::2], turns[1::2]
    row = begin // (w + 2)
    return row, begin - row * (w + 2), end - row * (w + 2) - 1


def linked_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row_runs, and of each run the first run of its 8-connected component; planes of a stack are not connected."""
    h, w = on.shape[-2:]
    row, lo, hi = row_runs(on)
    first = np.searchsorted(row * (w + 2) + hi, (row - 1) * (w + 2) + lo - 1)
    count = np.searchsorted(row * (w + 2) + lo, (row - 1) * (w + 2) + hi + 1, side="right") - first
    count[row % max(h, 1) == 0] = 0
    a = np.repeat(np.arange(len(row)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(len(row))
    while len(a):
        less, more = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = less != more
        a, b = a[apart], b[apart]
        np.minimum.at(root, more[apart], less[apart])
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return row, lo, hi, root


def labels(on: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components of a plane, or of each plane of a stack, numbered from 1 in raster order of their first pixel."""
    _, lo, hi, root = linked_runs(on)
    firsts = root == np.arange(len(root))
    out = np.zeros(on.shape, np.int32)
    out[on] = np.repeat(np.cumsum(firsts)[root], hi - lo + 1)
    return out, int(firsts.sum())


def canny(plane: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edges: ridges over `high`, and those over `low` that reach one of them."""
    ridge = thin(*sobel(plane))
    lab, n = labels(ridge > low)
    strong = np.zeros(n + 1, bool)
    strong[lab[ridge > high]] = True
    strong[0] = False
    # A strong ridge may lie under `low` where high <= low.
    return np.where(strong[lab] | (ridge > high), 255, 0).astype(np.uint8)


def edge_map(rgb: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    return canny(gaussian(gray(rgb)), low, high)


def closed(plane: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Dilations and erosions in turn; beyond the border nothing is set."""
    on = plane > 0
    h, w = on.shape[-2:]
    for _ in range(rounds):
        for join in (np.logical_or, np.logical_and):
            p = np.zeros((*on.shape[:-2], h + 2, w + 2), bool)
            p[..., 1:-1, 1:-1] = on
            p = join(join(p[..., :-2], p[..., 1:-1]), p[..., 2:])
            on = join(join(p[..., :-2, :], p[..., 1:-1, :]), p[..., 2:, :])
    return np.where(on, np.uint8(255), np.uint8(0))


def laplacian(plane: np.ndarray) -> np.ndarray:
    """Its size, of the interior."""
    p = plane.astype(np.int16)
    return np.abs(p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * p[..., 1:-1, 1:-1])


def blur_metric(plane: np.ndarray) -> float:
    if min(plane.shape) < 3:
        return 1000.0
    lap = laplacian(plane).astype(np.float64)
    return float(max(0.0, (lap * lap).mean() - lap.mean() ** 2))


def sauvola(plane: np.ndarray, window: int = 15, k: float = 0.2) -> np.ndarray:
    half = max(1, window // 2)
    h, w = plane.shape[-2:]
    v = plane.astype(np.float64)
    y0, y1 = np.maximum(np.arange(h) - half, 0), np.minimum(np.arange(h) + half + 1, h)
    x0, x1 = np.maximum(np.arange(w) - half, 0), np.minimum(np.arange(w) + half + 1, w)

    def summed(a: np.ndarray) -> np.ndarray:
        s = np.zeros((*a.shape[:-2], h + 1, w + 1))
        a.cumsum(-2).cumsum(-1, out=s[..., 1:, 1:])
        rows = s[..., y1, :] - s[..., y0, :]
        return rows[..., x1] - rows[..., x0]

    n = np.outer(y1 - y0, x1 - x0)
    mean = summed(v) / n
    std = np.sqrt(np.maximum(0, summed(v * v) / n - mean * mean))
    return np.where(v > mean * (1 + k * (std / 128 - 1)), np.uint8(255), np.uint8(0))


def otsu(plane: np.ndarray) -> int:
    hist = np.bincount(plane.ravel(), minlength=256).astype(np.float64)
    wb, sb = hist.cumsum(), (hist * np.arange(256)).cumsum()
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    q = np.where(ok, wb * wf * (sb / np.maximum(wb, 1) - (sb[-1] - sb) / np.maximum(wf, 1)) ** 2, 0)
    return int(q.argmax()) if q.max() > 0 else 0


def hexed(rgb) -> str:
    return "#{:02X}{:02X}{:02X}".format(*(int(v) for v in rgb))


def background(rgb: np.ndarray) -> str:
    rows = np.concatenate([rgb[:2], rgb[max(0, len(rgb) - 2) :]]).reshape(-1, 3).astype(np.int64)
    return hexed(rows.sum(axis=0) // len(rows)) if len(rows) else "#FFFFFF"


def _grid(rgb: np.ndarray, x: int, y: int, w: int, h: int, inset: int) -> np.ndarray:
    step = max(2, w // 16)
    return rgb[y + inset : y + h - inset : step, x + inset : x + w - inset : step].reshape(-1, 3).astype(np.int64)


def average(rgb: np.ndarray, x: int, y: int, w: int, h: int) -> str:
    on = _grid(rgb, x, y, w, h, 1)
    return hexed(on.sum(axis=0) // len(on)) if len(on) else ""


def features(rgb: np.ndarray, plane: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[float, float, float]:
    """Edge density, share of edge pixels near the border, colour variance of a box."""
    on = plane[y : y + h, x : x + w] > 0
    total = int(on.sum())
    ring = total - int(on[2:-2, 2:-2].sum()) if min(on.shape) > 4 else total
    v = _grid(rgb, x, y, w, h, 1 if w < 10 or h < 10 else 4).astype(np.float64)
    var = np.maximum(0, (v * v).mean(axis=0) - v.mean(axis=0) ** 2).sum() / (3 * 65025) if len(v) >= 4 else 0.0
    return total / (w * h), ring / total if total else 0.0, float(var)


def components(rgb: np.ndarray, edges: np.ndarray) -> list[dict]:
    """Bounding boxes of closed edges with their features, in raster order; densities in hundredths are left as they are, as doubles."""
    plane = closed(edges)
    lab, n = labels(plane > 0)
    if not n:
        return []
    ys, xs = np.nonzero(lab)
    which = lab[ys, xs] - 1
    box = np.stack([np.full(n, 1 << 30), np.full(n, 1 << 30), np.full(n, -1), np.full(n, -1)])
    for i, (at, v) in enumerate(((np.minimum.at, xs), (np.minimum.at, ys), (np.maximum.at, xs), (np.maximum.at, ys))):
        at(box[i], which, v)
    out = []
    for k, (x0, y0, x1, y1) in enumerate(box.T.tolist()):
        w, h = x1 - x0 + 1, y1 - y0 + 1
        if w >= 12 and h >= 10:
            ed, ring, var = features(rgb, plane, x0, y0, w, h)
            out.append({"k": k, "x": x0, "y": y0, "w": w, "h": h, "ed": 100 * ed, "ring": 100 * ring, "cv": 100 * var, "color": average(rgb, x0, y0, w, h)})
    return out


# Resampling and filters, by their public definitions.


def _lanczos(n_in: int, n_out: int) -> np.ndarray:
    scale = n_in / n_out
    wide = max(1.0, scale)
    at = (np.arange(n_out)[:, None] + 0.5) * scale - 0.5
    d = (np.arange(n_in)[None, :] - at) / wide
    m = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
    return m / m.sum(axis=1, keepdims=True)


def resample(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    out = np.einsum("ij,jkc->ikc", _lanczos(rgb.shape[0], h), rgb.astype(np.float64), optimize=True) if h != rgb.shape[0] else rgb.astype(np.float64)
    if w != rgb.shape[1]:
        out = np.einsum("ij,kjc->kic", _lanczos(rgb.shape[1], w), out, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def fitted_size(w: int, h: int, most: int) -> tuple[int, int]:
    """Width and height with the longer side at most `most`, the other in proportion."""
    if w <= most and h <= most:
        return w, h
    if w > h:
        return most, max(1, int(most * h / w + 0.5))
    return max(1, int(most * w / h + 0.5)), most


def fitted(rgb: np.ndarray, most: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    size = fitted_size(w, h, most)
    return rgb if size == (w, h) else resample(rgb, *size)


def contrast(rgb: np.ndarray, percent: float) -> np.ndarray:
    v = (100 + min(100, max(-100, percent))) / 100
    gain = v if v <= 1 else 1 / (2 - v)
    table = np.clip((0.5 + (np.arange(256) / 255 - 0.5) * gain) * 255 + 0.5, 0, 255).astype(np.uint8)
    return table[rgb]


def sharpen(rgb: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    v = rgb.astype(np.float64)
    soft = v
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p, ones = np.pad(soft, pad), np.pad(np.ones(soft.shape[axis]), r)
        n = soft.shape[axis]
        weight = sum(k * ones[i : i + n] for i, k in enumerate(kernel))
        soft = sum(k * np.take(p, range(i, i + n), axis=axis) for i, k in enumerate(kernel)) / weight.reshape([-1 if a == axis else 1 for a in range(3)])
    return np.clip(np.floor(2 * v - soft + 0.5), 0, 255).astype(np.uint8)


def preprocessed(rgb: np.ndarray, mode: str = "general", blur_threshold: float = 80.0) -> np.ndarray:
    metric = blur_metric(gray(rgb))
    if mode == "blur" or metric < blur_threshold:
        rgb = sharpen(contrast(rgb, 15), 0.8)
        h, w = rgb.shape[:2]
        return resample(rgb, 2 * w, 2 * h) if w < 800 or h < 600 else rgb
    if mode == "diagram":
        return contrast(rgb, 10)
    return sharpen(rgb, 0.4) if metric < 2 * blur_threshold else rgb


# Dominant colours.


def to_lab(rgb: np.ndarray) -> np.ndarray:
    from ..functions.text import TO_XYZ, WHITE

    c = rgb.astype(np.float64) / 255
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = lin @ np.array(TO_XYZ).T / np.array(WHITE)
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    from ..functions.text import FROM_XYZ, WHITE

    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * np.array(WHITE)
    lin = np.maximum(xyz @ np.array(FROM_XYZ).T, 0)
    c = np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * lin ** (1 / 2.4) - 0.055)
    return np.floor(np.clip(c, 0, 1) * 255 + 0.5).astype(np.uint8)


def kmeans(points: np.ndarray, k: int, rounds: int = 8, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their sizes, from evenly spaced points; an empty centre keeps its place and size. which: for each point in order its number in `points`, where equal ones are given once."""
    which = np.arange(len(points)) if which is None else which
    k, times = min(k, len(which)), np.bincount(which, minlength=len(points)).astype(np.float64)
    centers = points[which[np.arange(k) * len(which) // max(k, 1)]].astype(np.float64)
    sizes = np.zeros(k, np.int64)
    for _ in range(rounds):
        near = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        count = np.bincount(near, times, minlength=k).astype(np.int64)
        for c in range(points.shape[1]):
            total = np.bincount(near, points[:, c] * times, minlength=k)
            centers[:, c] = np.where(count > 0, total / np.maximum(count, 1), centers[:, c])
        sizes = np.where(count > 0, count, sizes)
    return centers, sizes


def kmeans_stack(points: np.ndarray, which: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """kmeans over the pixels of each image of a stack. which: [image, pixel], numbers in `points`. Sums run over the pixels in their order, so that what kmeans gives for one image is what this gives; an image whose pixels stay where they are is done."""
    n, size = which.shape
    centers = points[which[:, np.arange(k) * size // k]].astype(np.float64)
    sizes = np.zeros((n, k), np.int64)
    live, before = np.arange(n), np.full(which.shape, -1, np.int8)
    for _ in range(rounds):
        of, c = which[live], centers[live]
        image, first = np.arange(len(live))[:, None], np.sort(of, axis=1)
        # The nearest centre of each colour that an image has.
        new = np.ones(first.shape, bool)
        new[:, 1:] = first[:, 1:] != first[:, :-1]
        color, owner = first[new], np.nonzero(new)[0]
        d = points[color][:, None, :] - c[owner]
        table = np.zeros((len(live), len(points)), np.int8)
        table[owner, color] = (d**2).sum(axis=2).argmin(axis=1)
        near = table[image, of]
        moved = (near != before[live]).any(axis=1)
        live, near, of = live[moved], near[moved], of[moved]
        if not len(live):
            break
        before[live] = near
        cell = (np.arange(len(live))[:, None] * k + near).ravel()
        count = np.bincount(cell, minlength=len(live) * k).reshape(-1, k)
        for i in range(points.shape[1]):
            total = np.bincount(cell, points[of, i].ravel(), minlength=len(live) * k).reshape(-1, k)
            centers[live, :, i] = np.where(count > 0, total / np.maximum(count, 1), centers[live, :, i])
        sizes[live] = np.where(count > 0, count, sizes[live])
    return centers, sizes


def merged_centers(centers: np.ndarray, sizes: np.ndarray, reach: float) -> list[tuple[np.ndarray, int]]:
    """Each centre joins the first kept one within reach, weighted by size; two of size 0 keep the first's place."""
    out: list[tuple[np.ndarray, int]] = []
    for c, n in zip(centers, sizes.tolist(), strict=True):
        i = next((i for i, (o, _) in enumerate(out) if np.sqrt(((c - o) ** 2).sum()) < reach), None)
        if i is None:
            out.append((c, n))
        else:
            o, m = out[i]
            out[i] = ((o * m + c * n) / (m + n) if m + n else o, m + n)
    return out


def dominant(rgb: np.ndarray, n: int = 5, k: int = 5, reach: float = 12.0, most: int = 8000) -> list[str]:
    h, w = rgb.shape[:2]
    step = max(1, int((h * w / most) ** 0.5)) if h * w > most else 1
    px = rgb[::step, ::step].reshape(-1, 3).astype(np.int32)
    if not len(px):
        return ["#FFFFFF"]
    distinct, which = np.unique(px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2], return_inverse=True)
    points = to_lab(np.stack([distinct >> 16, distinct >> 8 & 255, distinct & 255], axis=1))
    found = sorted(merged_centers(*kmeans(points, k, which=which), reach), key=lambda x: -x[1])
    return [hexed(from_lab(c)) for c, _ in found][:n]


# Ruled tables and connectors.


@dataclass
class Line:
    pos: int
    lo: int
    hi: int

    def near(self, o: Line, gap: int = 14) -> bool:
        return abs(self.pos - o.pos) <= 2 and self.lo <= o.hi + gap and self.hi >= o.lo - gap

    def absorb(self, o: Line) -> None:
        self.lo, self.hi, self.pos = min(self.lo, o.lo), max(self.hi, o.hi), (self.pos + o.pos) // 2

    def share(self, o: Line) -> float:
        both, short = min(self.hi, o.hi) - max(self.lo, o.lo), min(self.hi - self.lo, o.hi - o.lo)
        return both / short if both > 0 and short > 0 else 0.0


def lines(edges: np.ndarray, least: int) -> list[Line]:
    """Horizontal runs of at least `least` edge pixels inside the border, close ones joined."""
    on = edges > 0
    on[[0, -1]] = False
    on[:, [0, -1]] = False
    ys, lo, hi = row_runs(np.ascontiguousarray(on))
    long = hi - lo + 1 >= least
    found: list[Line] = []
    for y, a, b in zip(ys[long].tolist(), lo[long].tolist(), hi[long].tolist(), strict=True):
        new = Line(y, a, b)
        host = next((m for m in found if new.near(m)), None)
        if host is None:
            found.append(new)
        else:
            host.absorb(new)
    for _ in range(3):
        before, i = len(found), 0
        while i < len(found):
            j = i + 1
            while j < len(found):
                if found[i].near(found[j]):
                    found[i].absorb(found.pop(j))
                else:
                    j += 1
            i += 1
        if len(found) == before:
            break
    return found


def tables(edges: np.ndarray, suppress_subtables: bool = False) -> list[dict]:
    """Ruled tables; every horizontal line may head one, so parts of a table are tables too unless suppressed."""
    h, w = edges.shape
    across = sorted(lines(edges, max(40, w // 6)), key=lambda s: s.pos)
    down = sorted(lines(edges.T, max(40, h // 6)), key=lambda s: s.pos)
    out: list[dict] = []
    for i, top in enumerate(across):
        band = [top] + [s for s in across[i + 1 :] if s.pos - top.pos <= h // 2 and top.share(s) > 0.6]
        last = band[-1]
        cross = [v for v in down if all(s.lo - 8 <= v.pos <= s.hi + 8 for s in (top, last)) and v.lo <= top.pos + 8 and v.hi >= last.pos - 8]
        if len(band) < 2 or len(cross) < 2:
            continue
        x0, x1 = min(s.lo for s in band), max(s.hi for s in band)
        t = {"x": x0, "y": top.pos, "w": x1 - x0, "h": last.pos - top.pos, "rows": len(band) - 1, "cols": len(cross) - 1}
        inside = any(o["x"] <= t["x"] and o["y"] <= t["y"] and o["x"] + o["w"] >= t["x"] + t["w"] and o["y"] + o["h"] >= t["y"] + t["h"] for o in out)
        if t["w"] >= 60 and t["h"] >= 40 and t["rows"] * t["cols"] > 1 and not (suppress_subtables and inside):
            out.append(t)
    return out


def connectors(edges: np.ndarray, radius: int = 6) -> list[dict]:
    """Long components of the edge plane as arrows from their less dense end to the denser one; ends are the least and the largest x + y (ties by y, x)."""
    lab, n = labels(edges > 0)
    ys, xs = np.nonzero(lab)
    order = np.argsort(lab[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    cut = np.searchsorted(lab[ys, xs], np.arange(1, n + 2))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        y, x = ys[a:b], xs[a:b]
        if len(x) < 12 or np.ptp(x) + np.ptp(y) < 30:
            continue
        ends = [int((x + y).argmin()), int((x + y).argmax())]
        dense = [int(((np.abs(x - x[i]) <= radius) & (np.abs(y - y[i]) <= radius)).sum()) for i in ends]
        src, dst = ends[::-1] if dense[0] > dense[1] else ends
        out.append({"ax": int(x[src]), "ay": int(y[src]), "bx": int(x[dst]), "by": int(y[dst])})
    return out
