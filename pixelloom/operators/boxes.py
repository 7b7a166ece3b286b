"""Operators on the box relation, boxes(image_id, k, type, x, y, w, h, color, score): filters, folds, joins, order, grids, page type.

Each function gives the SQL of an operator over a source (a table, view or
subquery). Everything is keyed by image_id, so each plan has one exchange on it;
folds are higher-order aggregates over one screen's boxes. A detection gives 40
boxes at most and a screen 60; the fold before that cap sees all components of a
screen that pass the filter, which lets none through under a 20000th of the canvas.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.text import Dialect

#: The detection's and the merged scales' limits.
DETECTED, MERGED = 40, 60


def elements(d: Dialect, source: str, width: int | str, height: int | str, min_area: int) -> str:
    """Components that may be elements, with type and score."""
    return f"SELECT image_id, k, {T.classify(width)} AS type, x, y, w, h, color, {T.score(width, height)} AS score FROM {source} WHERE {T.kept(width, height, min_area)}"


def ordered(d: Dialect, source: str, most: int = MERGED) -> str:
    """Reading order: bands of 20 pixels, then x; the rest of the keys settles ties. Rows beyond `most` of a screen go."""
    place = f"cast(row_number() OVER (PARTITION BY image_id ORDER BY {d.div('y', 20)}, x, y, w, h, type, k) AS bigint)"
    return f"SELECT * FROM (SELECT *, {place} AS ord FROM {source}) o WHERE ord <= {most}"


def _box(d: Dialect, *fields: str) -> str:
    return d.struct(**{f: f for f in fields})


def _sorted_list(d: Dialect, order: str, *fields: str) -> str:
    s = _box(d, order, *[f for f in fields if f != order])
    return d.call(f"array_sort(collect_list({s}))", f"list({s} ORDER BY {order})")


def dedup(d: Dialect, source: str, percent: int = 45, replace: bool = True) -> str:
    """First-match folds in order of k: a box that overlaps a kept one goes, or, with `replace`, takes its place if it scores more."""
    fields = ("k", "type", "x", "y", "w", "h", "color", "score")
    boxes = f"SELECT image_id, {_sorted_list(d, *fields)} AS bs FROM {source} GROUP BY image_id"
    over = T.iou_over("o.", "b.", percent)
    if d.name == "spark":
        at = f"array_position(transform(acc, o -> {over}), true)"
        hit = f"transform(acc, (o, i) -> CASE WHEN i + 1 = {at} AND b.score > o.score THEN b ELSE o END)" if replace else "acc"
        fold = f"aggregate(bs, slice(bs, 1, 0), (acc, b) -> CASE WHEN exists(acc, o -> {over}) THEN {hit} ELSE array_append(acc, b) END)"
        return f"SELECT image_id, b.* FROM (SELECT image_id, explode({fold}) AS b FROM ({boxes}) g)"
    over1 = T.iou_over("o.", "b[1].", percent)
    at = f"list_position(list_transform(acc, lambda o: {over1}), true)"
    hit = f"list_transform(acc, lambda o, i: CASE WHEN i = {at} AND b[1].score > o.score THEN b[1] ELSE o END)" if replace else "acc"
    fold = f"list_reduce(list_transform(bs, lambda s: [s]), lambda acc, b: CASE WHEN len(list_filter(acc, lambda o: {over1})) > 0 THEN {hit} ELSE list_concat(acc, b) END)"
    names = ", ".join(f"b.{f} AS {f}" for f in fields)
    return f"SELECT image_id, {names} FROM (SELECT image_id, unnest({fold}) AS b FROM ({boxes}) g)"


def overlaps(d: Dialect, source: str) -> str:
    """Pairs of a screen's boxes that overlap, with intersection over union."""
    return f"SELECT a.image_id, a.k AS k_a, b.k AS k_b, round({T.iou('a.', 'b.')}, 6) AS iou FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND a.k < b.k WHERE {T.inter('a.', 'b.')} > 0"


_SIDE = ("k", "type", "x", "y", "w", "h", "color")


def pairs(d: Dialect, a: str, b: str, percent: int = 50) -> str:
    """Greedy one-to-one matches of the boxes of a and b in order of k on both sides: (image_id, a_k, a_type, ..., b_k, ...); a's part is null for boxes of b without a match, and the other way round. Each side is read and grouped once."""
    left = f"SELECT image_id, {_sorted_list(d, *_SIDE)} AS xs FROM {a} GROUP BY image_id"
    right = f"SELECT image_id, {_sorted_list(d, *_SIDE)} AS ys FROM {b} GROUP BY image_id"
    both = f"SELECT coalesce(l.image_id, r.image_id) AS image_id, xs, ys FROM ({left}) l FULL OUTER JOIN ({right}) r ON l.image_id = r.image_id"
    names = ", ".join(f"{side}.{f} AS {side}_{f}" for side in "ab" for f in _SIDE)
    if d.name == "spark":
        kind = "struct<k: bigint, type: string, x: bigint, y: bigint, w: bigint, h: bigint, color: string>"
        free = f"filter(ys, b -> {T.iou_over('a.', 'b.', percent)} AND NOT exists(acc, m -> coalesce(m.b.k = b.k, false)))"
        fold = f"aggregate(xs, cast(array() AS array<struct<a: {kind}, b: {kind}>>), (acc, a) -> array_append(acc, named_struct('a', a, 'b', get({free}, 0))))"
        lists = f"SELECT image_id, coalesce(xs, cast(array() AS array<{kind}>)) AS xs, coalesce(ys, cast(array() AS array<{kind}>)) AS ys FROM ({both}) z"
        folded = f"SELECT image_id, ys, {fold} AS ms FROM (SELECT image_id, transform(xs, s -> {_cast_side('s', kind)}) AS xs, transform(ys, s -> {_cast_side('s', kind)}) AS ys FROM ({lists}) t) f"
        new = f"transform(filter(ys, b -> NOT exists(ms, m -> coalesce(m.b.k = b.k, false))), b -> named_struct('a', cast(NULL AS {kind}), 'b', b))"
        return f"SELECT image_id, {names} FROM (SELECT image_id, m.a AS a, m.b AS b FROM (SELECT image_id, explode(concat(ms, {new})) AS m FROM ({folded}) g) e) p"
    side = "{'k': CAST(NULL AS BIGINT), 'type': CAST(NULL AS VARCHAR), 'x': CAST(NULL AS BIGINT), 'y': CAST(NULL AS BIGINT), 'w': CAST(NULL AS BIGINT), 'h': CAST(NULL AS BIGINT), 'color': CAST(NULL AS VARCHAR)}"
    wide = f"list_transform(coalesce(xs, []), lambda s: [{{'a': s, 'b': {side}}}])"
    free = f"list_filter(coalesce(ys, []), lambda b: {T.iou_over('a[1].a.', 'b.', percent)} AND len(list_filter(acc, lambda m: m.b.k = b.k)) = 0)[1]"
    fold = f"list_reduce(list_concat([[{{'a': {side}, 'b': {side}}}]], {wide}), lambda acc, a: list_concat(acc, [{{'a': a[1].a, 'b': coalesce({free}, {side})}}]))[2:]"
    folded = f"SELECT image_id, coalesce(ys, []) AS ys, {fold} AS ms FROM ({both}) z"
    new = f"list_transform(list_filter(ys, lambda b: len(list_filter(ms, lambda m: m.b.k = b.k)) = 0), lambda b: {{'a': {side}, 'b': b}})"
    return f"SELECT image_id, {names} FROM (SELECT image_id, m.a AS a, m.b AS b FROM (SELECT image_id, unnest(list_concat(ms, {new})) AS m FROM ({folded}) g) e) p"


def _cast_side(s: str, kind: str) -> str:
    return f"cast({s} AS {kind})"


def matched(d: Dialect, a: str, b: str, percent: int = 50) -> str:
    """(image_id, a, b): the boxes of a, with their match or null."""
    return f"SELECT image_id, a_k AS a, b_k AS b FROM ({pairs(d, a, b, percent)}) p WHERE a_k IS NOT NULL"


def changes(d: Dialect, a: str, b: str) -> str:
    """pairs() with flags: moved, color_changed, removed, added; a pair may be moved and recoloured."""
    far = T.distance2(T.rgb(d, "a_color"), T.rgb(d, "b_color"))
    met = "a_k IS NOT NULL AND b_k IS NOT NULL"
    return f"""SELECT *, {met} AND (abs(a_x - b_x) > 5 OR abs(a_y - b_y) > 5) AS moved, {met} AND a_color <> '' AND b_color <> '' AND {far} > 625 AS color_changed,
b_k IS NULL AS removed, a_k IS NULL AS added FROM ({pairs(d, a, b)}) p"""


CHANGES = ("moved", "color_changed", "added", "removed")


def diff(d: Dialect, a: str, b: str, change: str) -> str:
    """(image_id, k_a, k_b) of one kind of change."""
    return f"SELECT image_id, a_k AS k_a, b_k AS k_b FROM ({changes(d, a, b)}) c WHERE {change}"


def diff_counts(d: Dialect, a: str, b: str) -> str:
    """The number of boxes on either side."""
    return f"SELECT image_id, count(a_k) AS a_boxes, count(b_k) AS b_boxes FROM ({pairs(d, a, b)}) p GROUP BY image_id"


def summary(d: Dialect, source: str) -> str:
    """A sentence for each screen of changes(): what moved, changed colour, came and went, each with its first example."""
    s = lambda v: f"cast({v} AS string)"
    said = {
        "moved": f"concat(' element(s) moved (e.g. ', a_type, ' (', {s('a_x')}, ',', {s('a_y')}, ') -> (', {s('b_x')}, ',', {s('b_y')}, '))')",
        "color_changed": "concat(' element(s) changed color (e.g. ', a_type, ' ', a_color, ' -> ', b_color, ')')",
        "added": f"concat(' added (e.g. ', b_type, ' at (', {s('b_x')}, ',', {s('b_y')}, '))')",
        "removed": f"concat(' removed (e.g. ', a_type, ' at (', {s('a_x')}, ',', {s('a_y')}, '))')",
    }
    first = lambda text, order, c: d.call(f"min_by(CASE WHEN {c} THEN {text} END, CASE WHEN {c} THEN {order} END)", f"arg_min({text}, {order}) FILTER (WHERE {c})")
    parts = ", ".join(f"CASE WHEN count(CASE WHEN {c} THEN 1 END) > 0 THEN concat({s(f'count(CASE WHEN {c} THEN 1 END)')}, {first(t, 'b_k' if c == 'added' else 'a_k', c)}) END" for c, t in said.items())
    return f"SELECT image_id, coalesce(nullif(concat_ws('; ', {parts}), ''), 'no structural changes detected') AS summary FROM {source} GROUP BY image_id"


def diff_summary(d: Dialect, a: str, b: str) -> str:
    return summary(d, f"({changes(d, a, b)}) c")


def nearest_box(d: Dialect, points: str, source: str, reach: int = 90) -> str:
    """The box nearest to each point (image_id, p, px, py) by distance to its rectangle, ties to the lower k; none beyond reach."""
    dx = f"greatest(0, abs(px - (x + {d.div('w', 2)})) - {d.div('w', 2)})"
    dy = f"greatest(0, abs(py - (y + {d.div('h', 2)})) - {d.div('h', 2)})"
    near = f"SELECT p.image_id, p, k, {dx} * {dx} + {dy} * {dy} AS dist FROM {points} p JOIN {source} b ON p.image_id = b.image_id"
    return f"SELECT image_id, p, k, dist FROM (SELECT *, row_number() OVER (PARTITION BY image_id, p ORDER BY dist, k) AS r FROM ({near}) n) z WHERE r = 1 AND dist <= {reach * reach}"


def nearest_center(d: Dialect, points: str, source: str, reach: int = 140) -> str:
    """The box whose centre is nearest to each point (image_id, p, own, px, py), but for box `own`; strictly within reach."""
    dx, dy = f"(px - (x + {d.div('w', 2)}))", f"(py - (y + {d.div('h', 2)}))"
    near = f"SELECT p.image_id, p, own, k, {dx} * {dx} + {dy} * {dy} AS dist FROM {points} p JOIN {source} b ON p.image_id = b.image_id AND p.own <> b.k"
    return f"SELECT image_id, p, own, k, dist FROM (SELECT *, row_number() OVER (PARTITION BY image_id, p, own ORDER BY dist, k) AS r FROM ({near}) n) z WHERE r = 1 AND dist < {reach * reach}"


def bar_ends(d: Dialect, source: str) -> str:
    """The two ends, 2 pixels out, of boxes long and thin enough to be connectors."""
    wide = "w >= h AND w >= 6 * h AND h <= 30"
    tall = "w < h AND h >= 6 * w AND w <= 30"
    cx, cy = f"x + {d.div('w', 2)}", f"y + {d.div('h', 2)}"
    return " UNION ALL ".join(f"SELECT image_id, {p} AS p, k AS own, {px} AS px, {py} AS py FROM {source} WHERE {c}" for p, px, py, c in ((0, "x - 2", cy, wide), (1, "x + w + 2", cy, wide), (0, cx, "y - 2", tall), (1, cx, "y + h + 2", tall)))


def bar_edges(d: Dialect, source: str) -> str:
    """(image_id, own, src, dst): the boxes that each bar connects."""
    near = nearest_center(d, f"({bar_ends(d, source)})", source)
    return f"SELECT a.image_id, a.own, a.k AS src, b.k AS dst FROM ({near}) a JOIN ({near}) b ON a.image_id = b.image_id AND a.own = b.own WHERE a.p = 0 AND b.p = 1 AND a.k <> b.k"


def distinct_edges(d: Dialect, edges: str) -> str:
    """Each undirected edge once, in the direction and at the place (own) of the first."""
    return f"SELECT image_id, own, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY image_id, least(src, dst), greatest(src, dst) ORDER BY own) AS r FROM {edges}) z WHERE r = 1"


def clusters(d: Dialect, values: str, tolerance: int = 10) -> str:
    """The number of 1-D clusters of a sorted list: a new one begins over `tolerance` from the cluster's first value."""
    if d.name == "spark":
        return f"aggregate({values}, named_struct('n', 0, 'a', cast(-1000000 AS bigint)), (acc, v) -> CASE WHEN v - acc.a > {tolerance} THEN named_struct('n', acc.n + 1, 'a', v) ELSE acc END).n"
    return f"list_reduce(list_transform(list_concat([CAST(-1000000 AS BIGINT)], {values}), lambda v: {{'n': 0, 'a': v}}), lambda acc, v: CASE WHEN v.a - acc.a > {tolerance} THEN {{'n': acc.n + 1, 'a': v.a}} ELSE acc END).n"


def grids(d: Dialect, source: str) -> str:
    """Grids of a screen, three at most: (image_id, cell, grid_cols, grid_rows, cells)."""
    ls = {c: d.call(f"array_sort(collect_list({c}))", f"list({c} ORDER BY {c})") for c in "xywh"}
    groups = f"SELECT image_id, type AS cell, count(*) AS n, {', '.join(f'{v} AS {c}s' for c, v in ls.items())} FROM {source} WHERE type IN ('card', 'image', 'button', 'avatar') GROUP BY image_id, type HAVING count(*) >= 4"
    mid = {c: d.call(f"element_at({c}s, cast(n div 2 AS int) + 1)", f"{c}s[n // 2 + 1]") for c in "wh"}
    sized = f"SELECT *, {mid['w']} AS mw, {mid['h']} AS mh FROM ({groups}) g"
    least = {c: d.call(f"element_at({c}s, 1)", f"{c}s[1]") for c in "wh"}
    most = {c: d.call(f"element_at({c}s, -1)", f"{c}s[-1]") for c in "wh"}
    even = " AND ".join(f"{least[c]} >= {d.div(f'm{c} * 3', 4)} AND {most[c]} <= {d.div(f'm{c} * 5', 4)}" for c in "wh")
    counted = f"SELECT image_id, cell, n, cast({clusters(d, 'xs')} AS int) AS grid_cols, cast({clusters(d, 'ys')} AS int) AS grid_rows FROM ({sized}) s WHERE {even}"
    found = f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, cell) AS r FROM ({counted}) c WHERE grid_cols >= 2 AND grid_rows >= 2 AND grid_cols * grid_rows <= {d.div('n * 4', 3)}"
    return f"SELECT image_id, cell, grid_cols, grid_rows, n AS cells FROM ({found}) f WHERE r <= 3"


def page_type(d: Dialect, images: str, source: str, width: int | str, height: int | str) -> str:
    """(image_id, n_boxes, page_type, confidence) of every screen (image_id, background), those without boxes too. Ties go to the first name."""
    h, v = T.horizontal(d, width, "b."), T.vertical(d, height, "b.")
    lum = T.luminance(*T.rgb(d, "background"))
    n = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
    counts = {
        "total": "count(b.k)", "inputs": n("b.type = 'input'"), "buttons": n("b.type = 'button'"), "lines": n("b.type = 'text_block'"),
        "centered": n(f"b.k IS NOT NULL AND {h} = 'center' AND {v} IN ('middle', 'bottom')"),
        "lefts": n(f"b.type IN ('card', 'text_block') AND {h} = 'left'"), "rights": n(f"b.type IN ('card', 'text_block') AND {h} = 'right'"),
        "low_input": n(f"b.type = 'input' AND {v} = 'bottom'"),
    }
    per = f"SELECT i.image_id, max(i.background) AS background, {', '.join(f'{c} AS {k}' for k, c in counts.items())} FROM {images} i LEFT JOIN {source} b ON i.image_id = b.image_id GROUP BY i.image_id"
    cards = f"SELECT image_id AS gi, max(cells) AS cells FROM ({grids(d, source)}) g WHERE cell = 'card' AND grid_cols * grid_rows >= 4 GROUP BY image_id"
    x = lambda s: f"cast({s} AS double)"
    scores = {
        "chat": f"CASE WHEN least(lefts, rights) >= 2 AND low_input > 0 THEN {x(0.55)} + {x(0.05)} * least(lefts + rights, 8) END",
        "dashboard": f"CASE WHEN cells IS NOT NULL THEN {x(0.6)} + {x(0.03)} * least(cells, 10) END",
        "form": f"CASE WHEN inputs >= 3 THEN {x(0.45)} + {x(0.05)} * least(inputs, 6) END",
        "login": f"CASE WHEN inputs BETWEEN 1 AND 3 AND buttons <= 2 AND total <= 14 THEN {x(0.35)} + {x(0.45)} * {x('centered')} / greatest(total, 1) END",
        "terminal": f"CASE WHEN {lum} < 60 AND lines >= 3 THEN {x(0.55)} + {x(0.05)} * least(lines, 8) END",
    }
    scored = f"SELECT image_id, total, {', '.join(f'coalesce({s}, {x(0)}) AS s_{k}' for k, s in scores.items())} FROM ({per}) p LEFT JOIN ({cards}) c ON p.image_id = c.gi"
    best = f"greatest({', '.join(f's_{k}' for k in scores)})"
    name = " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in scores)
    return f"SELECT image_id, total AS n_boxes, CASE WHEN {best} < 0.45 THEN 'general' {name} END AS page_type, CASE WHEN {best} < 0.45 THEN {x(0.4)} ELSE floor(least({x(0.95)}, {best}) * 100 + 0.5) / {x(100)} END AS confidence FROM ({scored}) s"
