"""Registered queries of the screen-structure engine, each with its check in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import text as T
from .functions.text import DUCKDB, SPARK, Dialect
from .operators import boxes as B
from .operators import layout as L
from .operators import pixels as P
from .oracles import SQL as ORACLES
from .plans import planes
from .sources import derived as S

W, H = S.WIDTH, S.HEIGHT


def _elements(d: Dialect) -> str:
    return f"({B.elements(d, f'({S.components_sql(d)}) c', W, H, S.MIN_AREA)}) e"


def _pages(d: Dialect) -> str:
    return f"(SELECT DISTINCT {d.div('event_id', 20)} AS image_id, CASE WHEN ({d.div('event_id', 20)}) % 5 = 2 THEN '#111111' ELSE '#FFFFFF' END AS background FROM events)"


def _ordered(d: Dialect) -> str:
    return f"(SELECT *, {T.caption(d, W, H)} AS caption FROM {T.with_channels(d, f'({B.ordered(d, _elements(d))}) q')} q2)"


def _sides(d: Dialect) -> tuple[str, str]:
    return "ea", "eb"


def _with_sides(d: Dialect, body: str) -> str:
    e = _elements(d)
    return f"WITH ea AS (SELECT * FROM {e}), eb AS ({S.second_sql(d, 'ea')}) {body}"


def _with(d: Dialect, body: str) -> str:
    """Over `el`, the elements."""
    return f"WITH el AS (SELECT * FROM {_elements(d)}) {body}"


def _steps(source: str, steps: list[dict[str, str]], keep: str, last: dict[str, str]) -> str:
    sql = source
    for s in steps:
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM ({sql}) z"
    return f"SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in last.items())} FROM ({sql}) z"


def _colored(d: Dialect) -> str:
    return f"SELECT DISTINCT color, {', '.join(f'{c} AS {n}' for c, n in zip(T.rgb(d, 'color'), 'rgb', strict=True))} FROM ({S.components_sql(d)}) c"


def _lab(d: Dialect) -> str:
    return _steps(_colored(d), T.lab_steps("r", "g", "b"), "color, r, g, b", {k: k for k in ("lab_l", "lab_a", "lab_b")})


def _merge_scales(d: Dialect) -> str:
    """Elements of the base scale and of a half one (every other box, mapped back), first wins over .55, then reading order."""
    half = ", ".join(f"{T.scaled(d, d.div(c, 2), '2')} AS {c}" for c in "xywh")
    both = f"SELECT image_id, k, type, x, y, w, h, color, score FROM el UNION ALL SELECT image_id, k + 1000, type, {half}, color, score FROM el WHERE k % 2 = 0"
    return _with(d, f"SELECT image_id, k, ord FROM ({B.ordered(d, f'({B.dedup(d, f'({both}) u', 55, replace=False)}) m')}) r")


#: Values that a configuration file may hold, by event; clamped as configurations are.
def _config(d: Dialect) -> str:
    raw = "SELECT event_id, event_id % 6000 - 50 AS max_side, (event_id * 7919) % 20000000 AS max_pixels, event_id % 300 AS min_area, event_id % 256 AS low, (event_id * 3) % 256 AS high, event_id % 20 AS colors FROM events"
    low = "CASE WHEN low = 0 THEN 50 ELSE low END"
    return f"SELECT event_id, CASE WHEN max_side < 64 THEN 1024 ELSE least(max_side, 4096) END AS max_side, CASE WHEN max_pixels < 100000 THEN 12000000 ELSE max_pixels END AS max_pixels, CASE WHEN min_area < 25 THEN 200 ELSE min_area END AS min_area, {low} AS canny_low, CASE WHEN high <= {low} THEN least(255, ({low}) * 3) ELSE high END AS canny_high, CASE WHEN colors < 1 THEN 5 ELSE least(colors, 16) END AS k FROM ({raw}) r"


def _limits(d: Dialect) -> str:
    """What the decoder says of a header's width and height."""
    raw = "SELECT event_id, (event_id * 37) % 20000 - 10 AS w, (event_id * 53) % 20000 - 10 AS h FROM events"
    return f"SELECT event_id, CASE WHEN w <= 0 OR h <= 0 THEN 'invalid dimensions' WHEN w > 16384 OR h > 16384 THEN 'side over limit' WHEN w * h > 12000000 THEN 'pixels over limit' ELSE 'ok' END AS verdict FROM ({raw}) r"


def _preprocess(d: Dialect) -> str:
    metric = P.blur_metric(d, f"({S.pixels_sql(d)}) p")
    return f"SELECT image_id, metric, CASE WHEN metric < 80 THEN 'enhance' WHEN metric < 160 THEN 'sharpen' ELSE 'keep' END AS ui, CASE WHEN metric < 80 THEN 'enhance' ELSE 'contrast' END AS diagram FROM ({metric}) m"


def _points(d: Dialect) -> str:
    """The middle of the top edge of each box, as a connector's end."""
    return f"(SELECT image_id, k AS p, x + {d.div('w', 2)} AS px, y - 5 AS py FROM el WHERE k % 3 = 0)"


def _markdown(d: Dialect) -> str:
    """Descriptions with every kind of line: orientations, tables, texts (of every third screen as an engine reads them), diagrams."""
    page = B.page_type(d, _pages(d), "el", W, H)
    nl = d.call("'\\n'", "chr(10)")
    rest = f"CASE WHEN p.image_id % 2 = 0 THEN 'general' ELSE 'diagram' END AS mode, p.image_id % 9 AS orientation, concat_ws(' ', i.background, '#336699') AS dominant, CASE WHEN p.image_id % 4 = 1 THEN concat('flowchart TD', {nl}, '  A[empty]', {nl}) END AS mermaid"
    pages = f"(SELECT p.image_id, {W} AS width, {H} AS height, i.background, page_type, confidence, {rest} FROM ({page}) p JOIN {_pages(d)} i ON p.image_id = i.image_id)"
    ordered = f"(SELECT *, {T.caption(d, W, H)} AS caption FROM {T.with_channels(d, '(' + B.ordered(d, 'el') + ') q')} q2)"
    tables = "(SELECT image_id, k AS i, x, y, w, h, k + 1 AS n_rows, k + 2 AS n_cols FROM el WHERE type = 'card' AND w > 200) tb"
    quote = d.call("'\\\\'", "chr(92)")
    words = f"CASE WHEN image_id % 3 = 0 THEN concat('says \"', color, {quote}) ELSE {T.guess_text()} END"
    texts = f"(SELECT image_id, k AS i, {words} AS words, x, y, w, h, cast(k % 20 AS double) / 20 AS conf FROM el WHERE {T.is_placeholder()}) tx"
    return _with(d, L.markdown(d, pages, ordered, f"({B.grids(d, 'el')})", tables, texts))


SQL: dict[str, Callable[[Dialect], str]] = {
    "filter_components": lambda d: f"SELECT image_id, k, {T.kept(W, H, S.MIN_AREA)} AS kept FROM ({S.components_sql(d)}) c",
    "classify_boxes": lambda d: f"SELECT image_id, k, type, score FROM {_elements(d)}",
    "type_counts": lambda d: f"SELECT image_id, type, count(*) AS n FROM {_elements(d)} GROUP BY image_id, type",
    "reading_order": lambda d: f"SELECT image_id, k, ord FROM {_ordered(d)}",
    "topk_boxes": lambda d: f"SELECT image_id, k, ord FROM ({B.ordered(d, _elements(d), 5)}) o",
    "page_type": lambda d: _with(d, B.page_type(d, _pages(d), "el", W, H)),
    "parse_hex": lambda d: f"SELECT color, {', '.join(f'{c} AS {n}' for c, n in zip(T.rgb(d, 'color'), 'rgb', strict=True))} FROM (SELECT DISTINCT CASE WHEN k % 7 = 3 THEN substr(color, 2) WHEN k % 7 = 5 THEN 'bad' ELSE color END AS color FROM ({S.components_sql(d)}) c) z",
    "color_name": lambda d: f"SELECT color, {T.color_name('r', 'g', 'b')} AS name FROM ({_colored(d)}) c",
    "luminance": lambda d: f"SELECT color, round({T.luminance('r', 'g', 'b')}, 6) AS lum FROM ({_colored(d)}) c",
    "color_distance": lambda d: f"SELECT color, round(sqrt(cast({T.distance2(['r', 'g', 'b'], ['59', '130', '246'])} AS double)), 6) AS distance FROM ({_colored(d)}) c",
    "rgb_to_lab": lambda d: _steps(_lab(d), [], "color", {k: f"round({k}, 5)" for k in ("lab_l", "lab_a", "lab_b")}),
    "lab_to_rgb": lambda d: _steps(_lab(d), T.rgb_steps(d, "lab_l", "lab_a", "lab_b"), "color", {f"out{i}": f"out{i}" for i in range(3)}),
    "delta_e": lambda d: f"SELECT color, round(sqrt((lab_l - 50) * (lab_l - 50) + lab_a * lab_a + lab_b * lab_b), 5) AS delta_e FROM ({_lab(d)}) l",
    "position_words": lambda d: f"SELECT image_id, k, {T.horizontal(d, W)} AS across, {T.vertical(d, H)} AS down FROM {_elements(d)}",
    "caption": lambda d: f"SELECT image_id, k, caption FROM {_ordered(d)}",
    "guess_text": lambda d: f"SELECT image_id, k, {T.guess_text()} AS placeholder, h AS size FROM {_elements(d)} WHERE {T.is_placeholder()}",
    "map_box": lambda d: f"SELECT image_id, k, {', '.join(f'{T.scaled(d, c, 0.75)} AS {c}' for c in 'xywh')} FROM {_elements(d)}",
    "iou_pairs": lambda d: _with(d, B.overlaps(d, "el")),
    "dedup_boxes": lambda d: f"SELECT image_id, k, type, x, y FROM ({B.dedup(d, _elements(d))}) z",
    "merge_scales": _merge_scales,
    "nearest_box": lambda d: _with(d, B.nearest_box(d, _points(d), "el")),
    "nearest_center": lambda d: _with(d, B.nearest_center(d, f"(SELECT image_id, p, p AS own, px, py FROM {_points(d)} po)", "el")),
    "bar_edges": lambda d: _with(d, B.bar_edges(d, "el")),
    "edge_dedup": lambda d: _with(d, "SELECT image_id, src, dst FROM (" + B.distinct_edges(d, f"({B.bar_edges(d, 'el')}) b") + ") e"),
    "diff_matched": lambda d: _with_sides(d, B.matched(d, *_sides(d))),
    **{f"diff_{c}": (lambda c: lambda d: _with_sides(d, B.diff(d, *_sides(d), c)))(c) for c in B.CHANGES},
    "diff_counts": lambda d: _with_sides(d, B.diff_counts(d, *_sides(d))),
    "diff_summary": lambda d: _with_sides(d, B.diff_summary(d, *_sides(d))),
    "grids": lambda d: _with(d, B.grids(d, "el")),
    "cluster_count": lambda d: _with(d, f"SELECT image_id, cast({B.clusters(d, 'xs')} AS int) AS columns_found FROM (SELECT image_id, {d.call('array_sort(collect_list(x))', 'list(x ORDER BY x)')} AS xs FROM el GROUP BY image_id) g"),
    "split_gaps": lambda d: _with(d, L.split(d, "el", "y", "image_id", "band").format(cols="image_id, k")),
    "layout_leaves": lambda d: _with(d, L.leaves(d, "el")),
    "layout_regions": lambda d: _with(d, L.regions(d, "el")),
    "layout_rows": lambda d: _with(d, L.rows_of_page(d, "el")),
    "layout_nodes": lambda d: _with(d, L.nodes(d, "el")),
    "hierarchy_edges": lambda d: _with(d, L.hierarchy(d, f"(SELECT n.*, o.ord FROM ({L.nodes(d, 'el')}) n LEFT JOIN ({B.ordered(d, 'el')}) o ON o.image_id = n.image_id AND o.k = n.k) t")),
    "mermaid_nodes": lambda d: L.graph_nodes(d, _ordered(d)),
    "mermaid_chain": lambda d: _with(d, L.chain(d, "el")),
    "markdown": _markdown,
    "config_clamps": _config,
    "decode_limits": _limits,
    "preprocess_decision": _preprocess,
    **{name: (lambda f: lambda d: f(d, f"({S.pixels_sql(d)}) p"))(f) for name, f in P.QUERIES.items()},
    **{name: (lambda f: lambda d: f(d, f"({S.pixels_sql(d)}) p", f"({S.small_boxes_sql(d)})"))(f) for name, f in P.OF_BOXES.items()},
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.over_events(spark, sf_dir, SQL[name](SPARK))

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each by its SQL; those that make pixels by their kernels, for which the SQL is the definition."""
    return {name: planes.query(name, SQL[name](SPARK)) if name in planes.PLANS else _query(name) for name in SQL}


def oracle_sql() -> dict[str, str]:
    """The queries' checks: written apart from them where there is one (oracles.py), else the same templates in DuckDB's SQL."""
    return {name: f(DUCKDB) for name, f in SQL.items()} | ORACLES
