"""Pixel stencils in long form, pixels(image_id, y, x, r, g, b): neighbours by window functions, all arithmetic on integers.

The kernels of operators/kernels.py are the production form, one pass an image; these plans are their relational definition.
"""

from __future__ import annotations

from ..functions.text import Dialect

_ROW, _COLUMN = "PARTITION BY image_id, y ORDER BY x", "PARTITION BY image_id, x ORDER BY y"


def gray(d: Dialect, source: str) -> str:
    return f"SELECT image_id, y, x, {d.div('19595 * r + 38470 * g + 7471 * b', 65536)} AS v FROM {source}"


def _around(source: str, *kept: str) -> str:
    """v with its eight neighbours: n<dy><dx> for -1, 0, 1 as a, o, z; null beyond the border. kept: other columns that stay."""
    rows = f"SELECT image_id, y, x, {''.join(f'{c}, ' for c in kept)}v AS noo, lag(v) OVER ({_ROW}) AS noa, lead(v) OVER ({_ROW}) AS noz FROM ({source}) s"
    up = ", ".join(f"lag(no{c}) OVER ({_COLUMN}) AS na{c}, lead(no{c}) OVER ({_COLUMN}) AS nz{c}" for c in "aoz")
    return f"SELECT *, {up} FROM ({rows}) r"


_INNER = "(naa IS NOT NULL AND nzz IS NOT NULL AND naz IS NOT NULL AND nza IS NOT NULL)"


def _smooth(d: Dialect, source: str) -> str:
    total = "naa + 2 * nao + naz + 2 * noa + 4 * noo + 2 * noz + nza + 2 * nzo + nzz"
    return f"SELECT image_id, y, x, CASE WHEN {_INNER} THEN {d.div(total, 16)} ELSE noo END AS v FROM ({_around(source)}) a"


def gaussian(d: Dialect, source: str) -> str:
    return _smooth(d, gray(d, source))


def _gradient(d: Dialect, source: str) -> str:
    gx, gy = "(naz + 2 * noz + nzz - naa - 2 * noa - nza)", "(nza + 2 * nzo + nzz - naa - 2 * nao - naz)"
    both = f"SELECT image_id, y, x, CASE WHEN {_INNER} THEN {gx} ELSE 0 END AS gx, CASE WHEN {_INNER} THEN {gy} ELSE 0 END AS gy, {_INNER} AS inside FROM ({_around(source)}) a"
    turn = "CASE WHEN NOT inside THEN 0 WHEN abs(gx) >= 2 * abs(gy) THEN 0 WHEN abs(gy) >= 2 * abs(gx) THEN 2 WHEN (gx >= 0) = (gy >= 0) THEN 1 ELSE 3 END"
    return f"SELECT image_id, y, x, least(255, abs(gx) + abs(gy)) AS v, {turn} AS dir FROM ({both}) g"


def sobel(d: Dialect, source: str) -> str:
    return f"SELECT image_id, y, x, v AS mag, dir FROM ({_gradient(d, gaussian(d, source))}) s"


def _thin(d: Dialect, source: str) -> str:
    g = _gradient(d, gaussian(d, source))
    near = _around(g, "dir")
    pairs = (("noa", "noz"), ("naa", "nzz"), ("nao", "nzo"), ("nza", "naz"))
    first = "CASE dir " + " ".join(f"WHEN {i} THEN {p[0]}" for i, p in enumerate(pairs)) + " END"
    second = "CASE dir " + " ".join(f"WHEN {i} THEN {p[1]}" for i, p in enumerate(pairs)) + " END"
    return f"SELECT image_id, y, x, CASE WHEN {_INNER} AND noo > 0 AND noo >= {first} AND noo > {second} THEN noo ELSE 0 END AS v FROM ({near}) n"


def nms(d: Dialect, source: str) -> str:
    return _thin(d, source)


def threshold(d: Dialect, source: str, over: int = 150) -> str:
    return f"SELECT image_id, y, x, CASE WHEN v > {over} THEN 255 ELSE 0 END AS v FROM ({gray(d, source)}) g"


def morph_close(d: Dialect, source: str) -> str:
    """One round over dark pixels: dilate, then erode; what lies beyond the border counts as unset in both."""
    dark = f"SELECT image_id, y, x, CASE WHEN v < 128 THEN 1 ELSE 0 END AS v FROM ({gray(d, source)}) g"
    cells = [f"n{a}{b}" for a in "aoz" for b in "aoz"]
    wide = f"SELECT image_id, y, x, greatest({', '.join(f'coalesce({c}, 0)' for c in cells)}) AS v FROM ({_around(dark)}) a"
    return f"SELECT image_id, y, x, least({', '.join(f'coalesce({c}, 0)' for c in cells)}) * 255 AS v FROM ({_around(wide)}) b"


def blur_metric(d: Dialect, source: str) -> str:
    lap = "abs(nao + nzo + noa + noz - 4 * noo)"
    laps = f"SELECT image_id, cast({lap} AS bigint) AS l FROM ({_around(gray(d, source))}) a WHERE {_INNER}"
    n, s, q = "count(*)", "sum(l)", "sum(l * l)"
    return f"SELECT image_id, round(greatest(cast(0 AS double), cast({q} AS double) / {n} - (cast({s} AS double) / {n}) * (cast({s} AS double) / {n})), 4) AS metric FROM ({laps}) l GROUP BY image_id"


def _mean_hex(d: Dialect) -> str:
    return "concat('#', " + ", ".join(d.hex2(f"cast({d.div(f'sum({c})', 'count(*)')} AS bigint)") for c in "rgb") + ")"


def background(d: Dialect, source: str, height: int = 48) -> str:
    """Mean colour of the two first and two last rows; rows of a low image count twice."""
    both = f"SELECT image_id, r, g, b FROM {source} WHERE y < 2 UNION ALL SELECT image_id, r, g, b FROM {source} WHERE y >= {height - 2}"
    return f"SELECT image_id, {_mean_hex(d)} AS background FROM ({both}) u GROUP BY image_id"


def _inside(d: Dialect, boxes: str, plane: str) -> str:
    """A row for each pixel of each box (image_id, k, x, y, w, h) that lies on the plane: the box as x0, y0, w, h, the pixel and what the plane has of it."""
    upto = lambda lo, hi: d.call(f"explode(sequence({lo}, {hi}))", f"unnest(range({lo}, {hi} + 1))")
    rows = f"SELECT image_id, k, x AS x0, y AS y0, w, h, {upto('y', 'y + h - 1')} AS y FROM {boxes} b WHERE w > 0 AND h > 0"
    cells = f"SELECT image_id, k, x0, y0, w, h, y, {upto('x0', 'x0 + w - 1')} AS x FROM ({rows}) r"
    return f"SELECT c.k, c.x0, c.y0, c.w, c.h, p.* FROM ({cells}) c JOIN ({plane}) p ON p.image_id = c.image_id AND p.y = c.y AND p.x = c.x"


def _sampled(d: Dialect, inset: str) -> str:
    """Whether a pixel of a box is looked at: every so many, from an inset on."""
    step = f"greatest(2, {d.div('w', 16)})"
    return f"x BETWEEN x0 + {inset} AND x0 + w - {inset} - 1 AND y BETWEEN y0 + {inset} AND y0 + h - {inset} - 1 AND (x - x0 - {inset}) % {step} = 0 AND (y - y0 - {inset}) % {step} = 0"


def avg_color(d: Dialect, source: str, boxes: str) -> str:
    return f"SELECT image_id, k, {_mean_hex(d)} AS color FROM ({_inside(d, boxes, f'SELECT * FROM {source}')}) i WHERE {_sampled(d, '1')} GROUP BY image_id, k"


def edge_density(d: Dialect, source: str, boxes: str) -> str:
    return f"SELECT image_id, k, round(cast(count(CASE WHEN v > 0 THEN 1 END) AS double) / max(w * h), 6) AS density FROM ({_inside(d, boxes, _thin(d, source))}) i GROUP BY image_id, k"


def ring_ratio(d: Dialect, source: str, boxes: str) -> str:
    ring = "(y - y0 < 2 OR y0 + h - 1 - y < 2 OR x - x0 < 2 OR x0 + w - 1 - x < 2)"
    return f"SELECT image_id, k, round(CASE WHEN count(CASE WHEN v > 0 THEN 1 END) = 0 THEN cast(0 AS double) ELSE cast(count(CASE WHEN v > 0 AND {ring} THEN 1 END) AS double) / count(CASE WHEN v > 0 THEN 1 END) END, 6) AS ring FROM ({_inside(d, boxes, _thin(d, source))}) i GROUP BY image_id, k"


def color_var(d: Dialect, source: str, boxes: str) -> str:
    on = _sampled(d, "CASE WHEN w < 10 OR h < 10 THEN 1 ELSE 4 END")
    var = " + ".join(f"greatest(cast(0 AS double), cast(sum({c} * {c}) AS double) / count(*) - (cast(sum({c}) AS double) / count(*)) * (cast(sum({c}) AS double) / count(*)))" for c in "rgb")
    return f"SELECT image_id, k, round(CASE WHEN count(*) < 4 THEN cast(0 AS double) ELSE ({var}) / 195075 END, 6) AS color_var FROM ({_inside(d, boxes, f'SELECT * FROM {source}')}) i WHERE {on} GROUP BY image_id, k"


def otsu(d: Dialect, source: str) -> str:
    """The threshold of the largest variance between classes, the first of equals."""
    bins = f"SELECT image_id, v, count(*) AS n FROM ({gray(d, source)}) g GROUP BY image_id, v"
    order = "PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sums = f"SELECT image_id, v, cast(sum(n) OVER ({order}) AS double) AS wb, cast(sum(v * n) OVER ({order}) AS double) AS sb, cast(sum(n) OVER (PARTITION BY image_id) AS double) AS wt, cast(sum(v * n) OVER (PARTITION BY image_id) AS double) AS st FROM ({bins}) b"
    between = f"SELECT image_id, v, wb * (wt - wb) * (sb / wb - (st - sb) / (wt - wb)) * (sb / wb - (st - sb) / (wt - wb)) AS q FROM ({sums}) s WHERE wt > wb"
    top = f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY q DESC, v) AS r FROM ({between}) z"
    return f"SELECT i.image_id, coalesce(t.v, 0) AS cut FROM (SELECT DISTINCT image_id FROM {source}) i LEFT JOIN (SELECT image_id, v FROM ({top}) q WHERE r = 1 AND q > 0) t ON t.image_id = i.image_id"


def sauvola(d: Dialect, source: str, k: float = 0.2) -> str:
    """Binary planes by local mean and deviation, 3 x 3."""
    cells = [f"n{a}{b}" for a in "aoz" for b in "aoz"]
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cells)
    s, q = " + ".join(f"coalesce({c}, 0)" for c in cells), " + ".join(f"coalesce({c} * {c}, 0)" for c in cells)
    sums = f"SELECT image_id, y, x, noo AS v, cast({n} AS double) AS n, cast({s} AS double) AS s, cast({q} AS double) AS q FROM ({_around(gray(d, source))}) a"
    std = "sqrt(greatest(cast(0 AS double), q / n - (s / n) * (s / n)))"
    return f"SELECT image_id, y, x, CASE WHEN v > s / n * (1 + cast({k} AS double) * ({std} / 128 - 1)) THEN 255 ELSE 0 END AS v FROM ({sums}) z"


def samples(d: Dialect, source: str, most: int = 200, width: int = 64, height: int = 48) -> str:
    step = max(1, int((width * height / most) ** 0.5)) if width * height > most else 1
    return f"SELECT image_id, y, x, r, g, b FROM {source} WHERE y % {step} = 0 AND x % {step} = 0"


def line_runs(d: Dialect, source: str, least: int = 8) -> str:
    """Runs of dark pixels along rows, borders left out: (image_id, pos, lo, hi)."""
    dark = f"SELECT image_id, y, x, x - row_number() OVER ({_ROW}) AS island FROM ({gray(d, source)}) g WHERE v < 200 AND y BETWEEN 1 AND 46 AND x BETWEEN 1 AND 62"
    return f"SELECT image_id, y AS pos, min(x) AS lo, max(x) AS hi FROM ({dark}) k GROUP BY image_id, y, island HAVING count(*) >= {least}"


def rotations(d: Dialect, source: str, width: int = 64, height: int = 48) -> str:
    """Where pixels go for each orientation from 2 to 8, as sums that tell any two placements apart."""
    to = {2: (f"{width - 1} - x", "y"), 3: (f"{width - 1} - x", f"{height - 1} - y"), 4: ("x", f"{height - 1} - y"), 5: ("y", "x"), 6: (f"{height - 1} - y", "x"), 7: (f"{height - 1} - y", f"{width - 1} - x"), 8: ("y", f"{width - 1} - x")}
    return " UNION ALL ".join(f"SELECT image_id, {o} AS orientation, cast(sum((({nx}) * 131 + ({ny})) * (r + 1)) AS bigint) AS placed FROM {source} GROUP BY image_id" for o, (nx, ny) in to.items())


QUERIES = {f.__name__: f for f in (gray, gaussian, sobel, nms, threshold, morph_close, blur_metric, background, otsu, sauvola, samples, line_runs, rotations)}
#: Those that look at boxes on the pixels.
OF_BOXES = {f.__name__: f for f in (avg_color, edge_density, ring_ratio, color_var)}
