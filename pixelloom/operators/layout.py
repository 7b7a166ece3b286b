"""Layout trees by alternating cuts, and the diagrams that are drawn from boxes and trees.

A tree is a relation of its nodes: unrolled rounds of gaps-and-islands windows cut the groups of a
screen, each box keeps the cuts that it comes from, and their prefixes are the containers;
no recursion, no per-screen Python.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.text import Dialect

DEPTH, GAP = 6, 12


def split(d: Dialect, source: str, axis: str, keys: str, name: str) -> str:
    """source with `name`: the number, from 0, of the group along an axis: groups are at least GAP apart."""
    lo, size = ("y", "h") if axis == "y" else ("x", "w")
    order = f"PARTITION BY {keys} ORDER BY {lo}, k"
    reach = f"max({lo} + {size}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    flagged = f"SELECT *, CASE WHEN {lo} - {reach} >= {GAP} THEN 1 ELSE 0 END AS jump FROM {source} s"
    told = f"SELECT *, cast(sum(jump) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS int) AS {name} FROM ({flagged}) f"
    return f"SELECT {{cols}}, {name} FROM ({told}) t"


def _round(d: Dialect, source: str, axis: str) -> str:
    """One cut of all groups that are still open, along an axis."""
    lo, size = ("y", "h") if axis == "y" else ("x", "w")
    mine = "PARTITION BY image_id, gid"
    order = f"{mine} ORDER BY {lo}, k"
    reach = f"max({lo} + {size}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    jumps = f"SELECT *, CASE WHEN {lo} - {reach} >= {GAP} THEN 1 ELSE 0 END AS jump, count(*) OVER ({mine}) AS n FROM {source} s"
    told = f"SELECT *, sum(jump) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g, sum(jump) OVER ({mine}) AS cut FROM ({jumps}) j"
    gid = f"CASE WHEN state = 'open' AND n > 1 AND cut > 0 THEN concat(gid, '{axis}', lpad(cast(g AS string), 3, '0'), '.') ELSE gid END"
    # A group that isn't cut along y is tried along x, one that isn't cut along x is a region.
    state = "CASE WHEN state <> 'open' THEN state WHEN n = 1 THEN 'leaf'" + (" WHEN cut = 0 THEN 'region'" if axis == "x" else "") + " ELSE 'open' END"
    return f"SELECT image_id, k, type, x, y, w, h, {gid} AS gid, {state} AS state FROM ({told}) t"


def cuts(d: Dialect, source: str) -> str:
    """The boxes with gid, the cuts that their group comes from (axis and number, five characters each), and state: leaf (alone), region (no cut goes on) or limit (DEPTH cuts tried)."""
    now = f"(SELECT image_id, k, type, x, y, w, h, '' AS gid, 'open' AS state FROM {source} s0)"
    for i in range(DEPTH):
        now = f"({_round(d, now, 'yx'[i % 2])})"
    return f"SELECT image_id, k, type, x, y, w, h, gid, CASE WHEN state <> 'open' THEN state WHEN count(*) OVER (PARTITION BY image_id, gid) = 1 THEN 'leaf' ELSE 'limit' END AS state FROM {now} c"


def leaves(d: Dialect, source: str) -> str:
    """(image_id, k, path, in_region): the cuts that each box comes from, and whether it lies with others that no cut parts."""
    return f"SELECT image_id, k, gid AS path, state = 'region' AS in_region FROM ({cuts(d, source)}) c"


def regions(d: Dialect, source: str) -> str:
    """Groups of two boxes or more that no cut splits: their bounding boxes and number of boxes."""
    return f"SELECT image_id, gid AS path, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS boxes FROM ({cuts(d, source)}) c WHERE state = 'region' GROUP BY image_id, gid"


def rows_of_page(d: Dialect, source: str) -> str:
    """The bands of the first cut, or the whole page: their bounding boxes, number of boxes and of columns."""
    band, column = "substr(gid, 1, 5)", "substr(gid, 6, 5)"
    first = f"SELECT *, CASE WHEN {band} LIKE 'y%' THEN cast(substr(gid, 2, 3) AS int) ELSE 0 END AS band, CASE WHEN {band} LIKE 'y%' THEN {column} ELSE {band} END AS col FROM ({cuts(d, source)}) c"
    return f"SELECT image_id, band, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS boxes, count(DISTINCT col) AS columns_in_band FROM ({first}) f GROUP BY image_id, band"


def nodes(d: Dialect, source: str) -> str:
    """The tree as a relation: (image_id, id, parent, type, k, x, y, w, h), id in preorder from 0, parent null under the root, k null but in leaves.

    A group that a cut leaves and another splits is a row (cut along y) or a col (along x), as is
    one at the last depth; one that no cut splits is a region; a group of one box is its box. Each
    box names all nodes that it lies in, so the boxes are cut and grouped once, without a join.
    """
    each, keep = d.call("explode", "unnest"), lambda a: d.call(f"filter({a}, s -> s.own IS NOT NULL)", f"list_filter({a}, lambda s: s.own IS NOT NULL)")
    many = lambda items: f"{d.call('array(', '[')}{', '.join(items)}{d.call(')', ']')}"
    last, up = "substr(gid, length(gid) - 4, 1)", "substr(gid, 1, greatest(length(gid) - 5, 0))"
    place = f"row_number() OVER (PARTITION BY image_id, gid ORDER BY CASE WHEN gid = '' THEN k WHEN {last} = 'y' THEN y ELSE x END, k)"
    placed = f"SELECT *, {place} AS place FROM ({cuts(d, source)}) c"
    node = lambda own, above, kind, k: d.struct(own=own, up=above, type=kind, k=k)
    none = "cast(NULL AS bigint)"
    names = [
        node("CASE WHEN state = 'leaf' THEN gid ELSE concat(gid, '/', lpad(cast(place AS string), 4, '0')) END", f"CASE WHEN state = 'leaf' THEN {up} ELSE gid END", "type", "cast(k AS bigint)"),
        node("CASE WHEN state = 'region' THEN gid END", up, "'region'", none),
        *(node(f"CASE WHEN length(gid) > {5 * i} OR (length(gid) = {5 * i} AND state = 'limit') THEN substr(gid, 1, {5 * i}) END", f"substr(gid, 1, {5 * i - 5})", f"CASE WHEN substr(gid, {5 * i - 4}, 1) = 'y' THEN 'row' ELSE 'col' END", none) for i in range(1, DEPTH + 1)),
    ]
    told = f"SELECT image_id, x, y, w, h, {each}({keep(many(names))}) AS n FROM ({placed}) p"
    sized = f"SELECT image_id, n.own AS own, n.up AS up, n.type AS type, n.k AS k, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({told}) t GROUP BY image_id, n.own, n.up, n.type, n.k"
    numbered = f"SELECT *, cast(row_number() OVER (PARTITION BY image_id ORDER BY own, coalesce(k, -1)) - 1 AS bigint) AS id FROM ({sized}) z"
    # Twice, beside its siblings and with its children: there the parent's number meets theirs.
    roles = f"SELECT *, {each}({many([d.struct(among='up', child='true'), d.struct(among='own', child='false')])}) AS r FROM ({numbered}) m"
    met = f"SELECT *, max(CASE WHEN NOT r.child AND k IS NULL THEN id END) OVER (PARTITION BY image_id, r.among) AS above FROM ({roles}) q"
    return f"SELECT image_id, id, CASE WHEN own <> up THEN above END AS parent, type, k, x, y, w, h FROM ({met}) o WHERE r.child"


def hierarchy(d: Dialect, tree: str) -> str:
    """A line for each node of nodes() (with ord, a box's place in reading order, or null): those under the root are declared, others are an edge from their parent."""
    label = "CASE WHEN ord IS NULL THEN type ELSE concat(type, ' #', cast(ord AS string)) END"
    line = f"CASE WHEN parent IS NULL THEN concat('  H', cast(id AS string), '[', {label}, ']') ELSE concat('  H', cast(parent AS string), ' --> H', cast(id AS string)) END"
    return f"SELECT image_id, id, {line} AS line FROM {tree}"


def node_line(label: str) -> str:
    return f"CASE type WHEN 'button' THEN concat('  N', id, '([', {label}, '])') WHEN 'image' THEN concat('  N', id, '[[', {label}, ']]') ELSE concat('  N', id, '[', {label}, ']') END"


def graph_nodes(d: Dialect, ordered: str) -> str:
    """A node line for each box (with ord)."""
    return f"SELECT image_id, ord, {node_line('label')} AS line FROM (SELECT image_id, ord, type, cast(ord - 1 AS string) AS id, concat(type, ' #', cast(ord AS string)) AS label FROM {ordered} o) n"


def chain(d: Dialect, source: str) -> str:
    """The older chain of boxes by y, then x: solid where the next is under 80 pixels away, else dotted."""
    told = f"SELECT image_id, type, y, w, h, cast(row_number() OVER (PARTITION BY image_id ORDER BY y, x, k) - 1 AS bigint) AS i, lag(y) OVER (PARTITION BY image_id ORDER BY y, x, k) AS before FROM {source} s"
    link = "CASE WHEN before IS NULL THEN '' WHEN abs(y - before) < 80 THEN concat('  N', cast(i - 1 AS string), ' --> N', id) ELSE concat('  N', cast(i - 1 AS string), ' -.-> N', id) END"
    return f"SELECT image_id, i, {node_line('label')} AS line, {link} AS link FROM (SELECT *, cast(i AS string) AS id, concat(type, ' ', cast(w AS string), 'x', cast(h AS string)) AS label FROM ({told}) t) c"


def table_lines(d: Dialect, tables: str) -> str:
    """(image_id, lines): a line for each ruled table (image_id, i, x, y, w, h, n_rows, n_cols), in order of i."""
    s = lambda v: f"cast({v} AS string)"
    line = f"concat('- Table at (', {s('x')}, ',', {s('y')}, ') ', {s('w')}, 'x', {s('h')}, ': ', {s('n_rows')}, ' rows x ', {s('n_cols')}, ' cols', {_newline(d)})"
    return f"SELECT image_id, {_joined(d, line, 'i')} AS lines FROM {tables} GROUP BY image_id"


def text_lines(d: Dialect, texts: str) -> str:
    """(image_id, was_read, lines): a line for each text (image_id, i, words, x, y, w, h, conf), in order of i; was_read where one is no placeholder, with its confidence then."""
    s = lambda v: f"cast({v} AS string)"
    place = f"concat(' at (', {s('x')}, ',', {s('y')}, ') ', {s('w')}, 'x', {s('h')})"
    quoted = f"concat('\"', replace(replace(words, {_backslash(d)}, concat({_backslash(d)}, {_backslash(d)})), '\"', concat({_backslash(d)}, '\"')), '\"')"
    read = f"max(CASE WHEN {T.was_read('words')} THEN 1 ELSE 0 END) OVER (PARTITION BY image_id)"
    rows = f"SELECT *, {read} AS r FROM {texts}"
    line = f"concat('  - ', CASE WHEN r = 1 THEN {quoted} ELSE words END, {place}, CASE WHEN r = 1 THEN concat(' conf ', {d.dec2('conf')}) ELSE '' END, {_newline(d)})"
    return f"SELECT image_id, max(r) = 1 AS was_read, {_joined(d, line, 'i')} AS lines FROM ({rows}) q GROUP BY image_id"


def _newline(d: Dialect) -> str:
    return d.call("'\\n'", "chr(10)")


def _backslash(d: Dialect) -> str:
    return d.call("'\\\\'", "chr(92)")


def _joined(d: Dialect, text: str, order: str) -> str:
    return d.call(f"array_join(transform(array_sort(collect_list(struct({order} AS o, {text} AS t))), z -> z.t), '')", f"string_agg({text}, '' ORDER BY {order})")


def markdown(d: Dialect, pages: str, ordered: str, grids: str, tables: str, texts: str, shown: int = 15) -> str:
    """A description of every screen (image_id, width, height, background, page_type, confidence, mode, orientation, dominant, mermaid) with its captioned boxes; dominant: colours in order, one space apart; tables, texts: as table_lines() and text_lines() take them."""
    s = lambda v: f"cast({v} AS string)"
    nl = _newline(d)
    boxes = f"SELECT image_id, count(*) AS n, {_joined(d, f"CASE WHEN ord <= {shown} THEN concat('  - #', {s('ord')}, ' ', caption, {nl}) ELSE '' END", 'ord')} AS lines FROM {ordered} o GROUP BY image_id"
    cells = f"SELECT image_id, {_joined(d, f"concat('- Grid: ', {s('grid_cols')}, 'x', {s('grid_rows')}, ' of ', cell, ' (', {s('cells')}, ' cells)', {nl})", 'cell')} AS lines FROM {grids} g GROUP BY image_id"
    more = f"CASE WHEN coalesce(b.n, 0) > {shown} THEN concat('  - ... and ', {s(f'b.n - {shown}')}, ' more', {nl}) ELSE '' END"
    read = "CASE WHEN coalesce(x.was_read, false) THEN 'OCR-read via ONNX PP-OCR (confidence per line)' ELSE 'NOT OCR-read; text fields are shape placeholders like [button]/[text]' END"
    parts = [
        "'## Image Facts ('", "mode", "')'", nl, "'- Size: '", s("width"), "'x'", s("height"), "' px'", nl,
        f"CASE WHEN orientation > 1 THEN concat('- EXIF orientation: ', {s('orientation')}, ' (auto-rotated)', {nl}) ELSE '' END",
        "'- Page type: '", "page_type", "' (confidence '", d.dec2("confidence"), "')'", nl, "coalesce(g.lines, '')", "coalesce(t.lines, '')",
        "'- Elements detected: '", s("coalesce(b.n, 0)"), "' boxes'", nl, "coalesce(b.lines, '')", more, "'- Text content: '", read, nl, "coalesce(x.lines, '')",
        "'- Dominant colors: ['", "coalesce(dominant, '')", "']'", nl, "'- Background: '", "background", nl,
        f"CASE WHEN coalesce(mermaid, '') <> '' THEN concat({nl}, '```mermaid', {nl}, mermaid, '```', {nl}) ELSE '' END",
    ]
    joins = f"LEFT JOIN ({boxes}) b ON p.image_id = b.image_id LEFT JOIN ({cells}) g ON p.image_id = g.image_id LEFT JOIN ({table_lines(d, tables)}) t ON p.image_id = t.image_id LEFT JOIN ({text_lines(d, texts)}) x ON p.image_id = x.image_id"
    return f"SELECT p.image_id, concat({', '.join(parts)}) AS markdown FROM {pages} p {joins}"
