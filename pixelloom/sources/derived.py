"""Relations with the shape of what pixel kernels emit, derived from tables by integer arithmetic: components of screens, and small screens' pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import DUCKDB, SPARK, Dialect

WIDTH, HEIGHT, MIN_AREA = 1000, 800, 200
#: Side of the small canvas of derived pixels, and what boxes are divided by.
PIX_W, PIX_H, SHRINK = 64, 48, 16


def components_sql(d: Dialect, events: str = "events") -> str:
    """(image_id, k, x, y, w, h, ed, ring, cv, color): five archetypes of screens by image_id % 5."""
    page, third = d.div("event_id", 20), d.div("k", 3)
    x = "CASE m WHEN 0 THEN CASE WHEN k < 6 THEN 10 + (k % 3) * 310 ELSE 20 + (k - 6) * 60 END WHEN 1 THEN CASE k WHEN 0 THEN 350 WHEN 3 THEN 420 ELSE 380 END WHEN 2 THEN 20 ELSE (e * 137) % 600 + (event_id - e) * 3 END"
    y = f"CASE m WHEN 0 THEN CASE WHEN k < 6 THEN 100 + {third} * 200 ELSE 560 END WHEN 1 THEN CASE k WHEN 0 THEN 250 WHEN 1 THEN 380 WHEN 2 THEN 440 ELSE 520 END WHEN 2 THEN 30 + k * 40 ELSE (e * 211) % 700 + (event_id - e) * 2 END"
    w = "CASE m WHEN 0 THEN CASE WHEN k < 6 THEN 290 ELSE 20 END WHEN 1 THEN CASE k WHEN 0 THEN 300 WHEN 3 THEN 160 ELSE 240 END WHEN 2 THEN 600 ELSE 12 + (e * 53) % 388 END"
    h = "CASE m WHEN 0 THEN CASE WHEN k < 6 THEN 180 ELSE 20 END WHEN 1 THEN CASE k WHEN 0 THEN 90 WHEN 3 THEN 44 ELSE 36 END WHEN 2 THEN 12 ELSE 10 + (e * 29) % 90 END"
    color = "concat('#', " + ", ".join(d.hex2(f"(e * {p}) % 256") for p in (67, 131, 29)) + ")"
    ints = ", ".join(f"cast({v} AS bigint) AS {n}" for n, v in (("x", x), ("y", y), ("w", w), ("h", h), ("ed", "CASE m WHEN 0 THEN 30 WHEN 2 THEN 10 ELSE (e * 13) % 60 END"), ("ring", "(e * 7) % 100"), ("cv", "(e * 11) % 10")))
    return f"""SELECT image_id, k, {ints}, {color} AS color
FROM (SELECT event_id, {page} AS image_id, event_id % 20 AS k, ({page}) % 5 AS m, event_id - CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS e FROM {events}) s
WHERE (m = 0 AND k < 12) OR (m = 1 AND k < 4) OR (m = 2 AND k < 8) OR m >= 3"""


def over_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the table `events` of a folder."""
    return over(spark.read.parquet(f"{sf_dir}/events.parquet"), sql)


def over(events: DataFrame, sql: str) -> DataFrame:
    """SQL over a table `events`."""
    whole = "WITH events AS (SELECT * FROM {source}) SELECT * FROM (" + sql.replace("{", "{{").replace("}", "}}") + ") whole"
    return events.sparkSession.sql(whole, source=events)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, components_sql(SPARK))


def second_sql(d: Dialect, source: str) -> str:
    """The other side of a comparison: some boxes moved, recoloured, gone, and one more for each fourth screen."""
    other = "concat('#', " + ", ".join(d.hex2(f"(k * {p} + image_id) % 256") for p in (41, 83, 17)) + ")"
    return f"""SELECT image_id, k, type, x + CASE WHEN k % 3 = 0 THEN 7 ELSE 0 END AS x, y, w, h, CASE WHEN k % 4 = 0 THEN {other} ELSE color END AS color FROM {source} WHERE k % 5 <> 4
UNION ALL SELECT image_id, cast(100 AS bigint), 'card', cast(900 AS bigint), cast(700 AS bigint), cast(60 AS bigint), cast(40 AS bigint), '#102030' FROM {source} WHERE k = 0 AND image_id % 4 = 0"""


def small_boxes_sql(d: Dialect, events: str = "events") -> str:
    """(image_id, k, x, y, w, h): the boxes as they lie on the small canvas."""
    return f"SELECT image_id, k, {', '.join(f'{d.div(c, SHRINK)} AS {c}' for c in 'xy')}, {', '.join(f'{d.div(c, SHRINK)} + 1 AS {c}' for c in 'wh')} FROM ({components_sql(d, events)}) c"


def pixels_sql(d: Dialect, events: str = "events") -> str:
    """(image_id, y, x, r, g, b): a white canvas with all boxes of a screen, shrunk, for every screen; later boxes lie on top. Each box gives its own pixels, each screen its canvas."""
    boxes = f"(SELECT image_id, k, {', '.join(f'{d.div(c, SHRINK)} AS {c}' for c in 'xywh')}, (k * 67 + image_id * 31) % 256 AS r, (k * 131) % 256 AS g, (image_id * 29) % 256 AS b FROM ({components_sql(d, events)}) c)"
    upto = lambda lo, hi: d.call(f"explode(sequence(cast({lo} AS bigint), cast({hi} AS bigint)))", f"unnest(range({lo}, {hi} + 1))")
    rows = f"SELECT image_id, {upto('y', f'least(y + h, {PIX_H - 1})')} AS y, x, least(x + w, {PIX_W - 1}) AS last, k * 16777216 + r * 65536 + g * 256 + b AS v FROM {boxes} q WHERE y < {PIX_H} AND x < {PIX_W}"
    painted = f"SELECT image_id, y, {upto('x', 'last')} AS x, v FROM ({rows}) p"
    screens = f"SELECT image_id, {upto(0, PIX_H - 1)} AS y FROM (SELECT DISTINCT {d.div('event_id', 20)} AS image_id FROM {events}) i"
    canvas = f"SELECT image_id, y, {upto(0, PIX_W - 1)} AS x, cast(NULL AS bigint) AS v FROM ({screens}) s"
    top = f"SELECT image_id, y, x, max(v) AS v FROM ({painted} UNION ALL {canvas}) u GROUP BY image_id, y, x"
    return f"SELECT image_id, y, x, coalesce({d.div('v', 65536)} % 256, 255) AS r, coalesce({d.div('v', 256)} % 256, 255) AS g, coalesce(v % 256, 255) AS b FROM ({top}) z"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, pixels_sql(SPARK))


__all__ = ["DUCKDB", "SPARK", "components", "components_sql", "over_events", "pixels", "pixels_sql", "second_sql"]
