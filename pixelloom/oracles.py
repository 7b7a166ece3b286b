"""Checks in DuckDB's SQL that are written apart from the operators' templates: rules as plain arithmetic, folds as recursion over the boxes in order."""

from __future__ import annotations

from .functions.text import DUCKDB
from .sources import derived as S

W, H = S.WIDTH, S.HEIGHT

_ELEMENTS = f"""raw AS MATERIALIZED ({S.components_sql(DUCKDB)}),
el AS MATERIALIZED (SELECT image_id, k, x, y, w, h, color, CASE
  WHEN w >= 12 AND w <= 28 AND h >= 12 AND h <= 28 AND 10 * w > 7 * h AND 10 * w < 14 * h AND ring > 45 AND cv < 2 THEN 'checkbox'
  WHEN w < 40 AND h < 40 AND ed > 15 THEN 'icon'
  WHEN 5 * w >= 4 * h AND 4 * w <= 5 * h AND w >= 30 AND w <= 140 AND h >= 30 AND h <= 140 AND cv > 4 THEN 'avatar'
  WHEN 10 * w > 32 * h AND h > 14 AND h < 70 AND ed < 30 THEN 'input'
  WHEN 10 * w > 14 * h AND w < 6 * h AND w > 50 AND h > 20 AND h < 85 AND w * h < 40000 AND ed > 8 AND ed < 50 THEN 'button'
  WHEN 4 * w < 5 * h AND w > 35 AND h > 35 AND w < 400 AND h < 400 AND ed < 40 THEN 'image'
  WHEN 2 * w > {W} AND h > 50 THEN 'card'
  WHEN ed > 2 AND ed < 25 AND h < 35 AND w > 25 THEN 'text_block'
  ELSE 'card' END AS type,
  round(least(1.0::DOUBLE, (w * h)::DOUBLE / {W * H} * 0.5 + ed::DOUBLE / 100 * 0.5), 9) AS score
  FROM raw WHERE w >= 12 AND h >= 10 AND w * h >= {S.MIN_AREA} AND (w * h + 1) * 20000 > {W * H} AND 10 * w * h <= 9 * {W * H})"""


def _share(a: str, b: str) -> str:
    """Intersection over union, as a double."""
    across = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    down = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(({across} * {down})::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {across} * {down}))"


#: Greedy matches: the boxes of a in order, each taking the first free box of b that shares over half with it.
_MATCHES = f"""{_ELEMENTS},
other AS MATERIALIZED ({S.second_sql(DUCKDB, "el")}),
turns AS (SELECT image_id, k, row_number() OVER (PARTITION BY image_id ORDER BY k) AS turn FROM el),
wishes AS MATERIALIZED (SELECT t.image_id, t.turn, t.k, (SELECT list(o.k ORDER BY o.k) FROM other o JOIN el e ON e.image_id = o.image_id WHERE e.image_id = t.image_id AND e.k = t.k AND {_share("e", "o")} > 0.5) AS wanted FROM turns t),
greedy AS (SELECT image_id, 0::BIGINT AS turn, NULL::BIGINT AS a, NULL::BIGINT AS b, []::BIGINT[] AS used FROM (SELECT DISTINCT image_id FROM el)
  UNION ALL SELECT image_id, turn, a, b, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END FROM
  (SELECT w.image_id, w.turn, w.k AS a, list_filter(w.wanted, lambda k: NOT list_contains(g.used, k))[1] AS b, g.used FROM greedy g JOIN wishes w ON w.image_id = g.image_id AND w.turn = g.turn + 1)),
met AS MATERIALIZED (SELECT image_id, a, b FROM greedy WHERE turn > 0),
told AS (SELECT m.image_id, m.a, m.b, p.type AS kind, p.x AS ax, p.y AS ay, p.color AS ac, q.x AS bx, q.y AS bby, q.color AS bc FROM met m JOIN el p ON p.image_id = m.image_id AND p.k = m.a JOIN other q ON q.image_id = m.image_id AND q.k = m.b),
moved AS (SELECT * FROM told WHERE ax NOT BETWEEN bx - 5 AND bx + 5 OR ay NOT BETWEEN bby - 5 AND bby + 5),
recolored AS (SELECT * FROM told WHERE sqrt((('0x' || ac[2:3])::INT - ('0x' || bc[2:3])::INT) ** 2 + (('0x' || ac[4:5])::INT - ('0x' || bc[4:5])::INT) ** 2 + (('0x' || ac[6:7])::INT - ('0x' || bc[6:7])::INT) ** 2) > 25),
gone AS (SELECT m.image_id, m.a, p.type, p.x, p.y FROM met m JOIN el p ON p.image_id = m.image_id AND p.k = m.a WHERE b IS NULL),
come AS (SELECT * FROM other o WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.image_id = o.image_id AND m.b = o.k))"""

_FIRST = "(SELECT image_id, count(*) AS n, arg_min({text}, {key}) AS said FROM {rows} GROUP BY image_id) {name} ON {name}.image_id = i.image_id"

SQL = {
    "classify_boxes": f"WITH {_ELEMENTS} SELECT image_id, k, type, score FROM el",
    "type_counts": f"WITH {_ELEMENTS} SELECT image_id, type, count(*) AS n FROM el GROUP BY ALL",
    "diff_matched": f"WITH RECURSIVE {_MATCHES} SELECT * FROM met",
    "diff_moved": f"WITH RECURSIVE {_MATCHES} SELECT image_id, a AS k_a, b AS k_b FROM moved",
    "diff_color_changed": f"WITH RECURSIVE {_MATCHES} SELECT image_id, a AS k_a, b AS k_b FROM recolored",
    "diff_removed": f"WITH RECURSIVE {_MATCHES} SELECT image_id, a AS k_a, NULL::BIGINT AS k_b FROM gone",
    "diff_added": f"WITH RECURSIVE {_MATCHES} SELECT image_id, NULL::BIGINT AS k_a, k AS k_b FROM come",
    "diff_counts": f"WITH {_ELEMENTS}, other AS ({S.second_sql(DUCKDB, 'el')}) SELECT image_id, count(*) FILTER (WHERE side = 1) AS a_boxes, count(*) FILTER (WHERE side = 2) AS b_boxes FROM (SELECT image_id, 1 AS side FROM el UNION ALL SELECT image_id, 2 FROM other) GROUP BY image_id",
    "diff_summary": f"""WITH RECURSIVE {_MATCHES}
SELECT i.image_id, CASE WHEN coalesce(m.n, c.n, n.n, g.n) IS NULL THEN 'no structural changes detected' ELSE array_to_string(list_filter([
  m.n || ' element(s) moved (e.g. ' || m.said || ')', c.n || ' element(s) changed color (e.g. ' || c.said || ')', n.n || ' added (e.g. ' || n.said || ')', g.n || ' removed (e.g. ' || g.said || ')'], lambda s: s IS NOT NULL), '; ') END AS summary
FROM (SELECT image_id FROM el UNION SELECT image_id FROM other) i
LEFT JOIN {_FIRST.format(text="printf('%s (%d,%d) -> (%d,%d)', kind, ax, ay, bx, bby)", key="a", rows="moved", name="m")}
LEFT JOIN {_FIRST.format(text="kind || ' ' || ac || ' -> ' || bc", key="a", rows="recolored", name="c")}
LEFT JOIN {_FIRST.format(text="printf('%s at (%d,%d)', type, x, y)", key="k", rows="come", name="n")}
LEFT JOIN {_FIRST.format(text="printf('%s at (%d,%d)', type, x, y)", key="a", rows="gone", name="g")}""",
    # The fold: a box that shares over .45 with a kept one goes, or takes the place of the first such one if it scores more.
    "dedup_boxes": f"""WITH RECURSIVE {_ELEMENTS},
turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k) AS turn FROM el),
pairs AS MATERIALIZED (SELECT e.image_id, e.turn, list(o.turn) AS near FROM turns e JOIN turns o ON o.image_id = e.image_id AND o.turn < e.turn AND {_share("e", "o")} > 0.45 GROUP BY ALL),
fold AS (SELECT image_id, 0::BIGINT AS turn, []::BIGINT[] AS kept FROM (SELECT DISTINCT image_id FROM el)
  UNION ALL SELECT image_id, turn, CASE WHEN spot IS NULL THEN list_append(kept, turn) WHEN better THEN list_concat(list_append(kept[:spot - 1], turn), kept[spot + 1:]) ELSE kept END FROM
  (SELECT z.*, z.score > o.score AS better FROM
    (SELECT f.image_id, t.turn, f.kept, t.score, list_position(list_transform(f.kept, lambda i: list_contains(coalesce(p.near, []), i)), true) AS spot
     FROM fold f JOIN turns t ON t.image_id = f.image_id AND t.turn = f.turn + 1 LEFT JOIN pairs p ON p.image_id = t.image_id AND p.turn = t.turn) z
   LEFT JOIN turns o ON o.image_id = z.image_id AND o.turn = z.kept[z.spot])),
ends AS (SELECT image_id, unnest(arg_max(kept, turn)) AS turn FROM fold GROUP BY image_id)
SELECT t.image_id, t.k, t.type, t.x, t.y FROM ends e JOIN turns t ON t.image_id = e.image_id AND t.turn = e.turn""",
    "page_type": f"""WITH RECURSIVE {_ELEMENTS},
pages AS (SELECT DISTINCT event_id // 20 AS image_id, CASE WHEN event_id // 20 % 5 = 2 THEN 17 ELSE 255 END AS grey FROM events),
spots AS (SELECT *, (x + w // 2)::DOUBLE / {W} AS cx, (y + h // 2)::DOUBLE / {H} AS cy FROM el),
cards AS (SELECT image_id, x, y, w, h FROM el WHERE type = 'card'),
mids AS (SELECT image_id, count(*) AS n, list_sort(list(w))[count(*) // 2 + 1] AS mw, list_sort(list(h))[count(*) // 2 + 1] AS mh, min(w) AS w0, max(w) AS w1, min(h) AS h0, max(h) AS h1 FROM cards GROUP BY image_id HAVING count(*) >= 4),
even AS (SELECT image_id, n FROM mids WHERE w0 >= mw * 3 // 4 AND w1 <= mw * 5 // 4 AND h0 >= mh * 3 // 4 AND h1 <= mh * 5 // 4),
lines AS (SELECT image_id, 'x' AS axis, list_sort(list_distinct(list(x))) AS v FROM cards JOIN even USING (image_id) GROUP BY image_id UNION ALL SELECT image_id, 'y', list_sort(list_distinct(list(y))) FROM cards JOIN even USING (image_id) GROUP BY image_id),
walk AS (SELECT image_id, axis, v, v[1] AS anchor, 1 AS n FROM lines UNION ALL SELECT image_id, axis, v, list_filter(v, lambda c: c > anchor + 10)[1], n + 1 FROM walk WHERE list_filter(v, lambda c: c > anchor + 10)[1] IS NOT NULL),
groups AS (SELECT image_id, max(n) FILTER (WHERE axis = 'x') AS cols, max(n) FILTER (WHERE axis = 'y') AS rws FROM walk GROUP BY image_id),
grid AS (SELECT image_id, n FROM even JOIN groups USING (image_id) WHERE cols >= 2 AND rws >= 2 AND cols * rws <= n * 4 // 3 AND cols * rws >= 4),
facts AS (SELECT p.image_id, any_value(grey) AS grey, count(s.k) AS total, count(*) FILTER (WHERE type = 'input') AS inputs, count(*) FILTER (WHERE type = 'button') AS buttons, count(*) FILTER (WHERE type = 'text_block') AS texts,
  count(*) FILTER (WHERE cx >= 0.36 AND cx <= 0.64 AND cy >= 0.33) AS centred, count(*) FILTER (WHERE type IN ('card', 'text_block') AND cx < 0.36) AS lefts, count(*) FILTER (WHERE type IN ('card', 'text_block') AND cx > 0.64) AS rights,
  count(*) FILTER (WHERE type = 'input' AND cy > 0.67) AS low FROM pages p LEFT JOIN spots s ON s.image_id = p.image_id GROUP BY p.image_id),
marks AS (SELECT f.image_id, total, unnest([
  {{'name': 'chat', 'v': CASE WHEN lefts >= 2 AND rights >= 2 AND low > 0 THEN 0.55::DOUBLE + 0.05::DOUBLE * least(lefts + rights, 8) ELSE 0 END}},
  {{'name': 'dashboard', 'v': CASE WHEN g.n IS NOT NULL THEN 0.6::DOUBLE + 0.03::DOUBLE * least(g.n, 10) ELSE 0 END}},
  {{'name': 'form', 'v': CASE WHEN inputs >= 3 THEN 0.45::DOUBLE + 0.05::DOUBLE * least(inputs, 6) ELSE 0 END}},
  {{'name': 'login', 'v': CASE WHEN inputs IN (1, 2, 3) AND buttons <= 2 AND total <= 14 THEN 0.35::DOUBLE + 0.45::DOUBLE * centred::DOUBLE / greatest(total, 1) ELSE 0 END}},
  {{'name': 'terminal', 'v': CASE WHEN grey < 60 AND texts >= 3 THEN 0.55::DOUBLE + 0.05::DOUBLE * least(texts, 8) ELSE 0 END}}]) AS m FROM facts f LEFT JOIN grid g USING (image_id)),
best AS (SELECT image_id, any_value(total) AS n_boxes, max(m.v) AS v, min(m.name) FILTER (WHERE m.v = t) AS name FROM (SELECT *, max(m.v) OVER (PARTITION BY image_id) AS t FROM marks) GROUP BY image_id)
SELECT image_id, n_boxes, CASE WHEN v < 0.45 THEN 'general' ELSE name END AS page_type, CASE WHEN v < 0.45 THEN 0.4::DOUBLE ELSE floor(least(0.95::DOUBLE, v) * 100 + 0.5) / 100::DOUBLE END AS confidence FROM best""",
}
