"""The screen-structure engine: every query against DuckDB, fixtures by hand, kernels against their relational definition."""

import duckdb
import numpy as np
import pytest

from pixelloom import config
from pixelloom import queries as Q
from pixelloom.functions import text as T
from pixelloom.functions.text import SPARK as D
from pixelloom.operators import boxes as B
from pixelloom.operators import kernels as K
from pixelloom.operators import layout as L
from pixelloom.operators import pixels as P
from pixelloom.plans import extract as E
from pixelloom.plans import ocr, planes
from pixelloom.plans import registered as R
from pixelloom.sources import derived as S
from pixelloom.sources import images as I

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_duckdb(spark, name):
    got = Q.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cur = con.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    assert have == want


def boxes(spark, rows, image_id=1, score=0.5):
    return spark.createDataFrame([(image_id, k, *r[:5], r[5] if len(r) > 5 else "#FFFFFF", score) for k, r in enumerate(rows)], "image_id long, k long, type string, x long, y long, w long, h long, color string, score double")


def sql(spark, text, **sources):
    return E._sql(spark, text, **sources).collect()


def page(spark, rows, w, h, bg):
    images = spark.createDataFrame([(1, bg)], "image_id long, background string")
    return sql(spark, B.page_type(D, "pg", "el", w, h), pg=images, el=boxes(spark, rows))[0]


def test_page_types(spark):
    login = [("card", 350, 250, 300, 40), ("input", 380, 380, 240, 36), ("input", 380, 440, 240, 36), ("button", 420, 520, 160, 44)]
    got = page(spark, login, 1000, 800, "#FFFFFF")
    assert got.page_type == "login" and got.confidence >= 0.45
    cards = [("card", 10, 10, 900, 60)]
    assert page(spark, cards, 920, 500, "#FFFFFF").page_type == "general"
    lines = [("text_block", 20, 30 + 40 * i, 600, 24) for i in range(5)]
    assert page(spark, lines, 640, 400, "#111111").page_type == "terminal"
    six = [("card", x, y, 290, 180) for y in (100, 300) for x in (10, 310, 610)]
    assert page(spark, six, 920, 500, "#FFFFFF").page_type == "dashboard"


def test_grid(spark):
    six = [("card", 10 + 120 * c, 10 + 80 * r, 100, 60) for r in range(2) for c in range(3)]
    (g,) = sql(spark, B.grids(D, "el"), el=boxes(spark, six))
    assert (g.cell, g.grid_cols, g.grid_rows, g.cells) == ("card", 3, 2, 6)


@pytest.mark.parametrize("hexed, name", [("#FF0000", "red"), ("#000000", "black"), ("#FFFFFF", "white"), ("#3B82F6", "blue"), ("#808080", "gray"), ("#BDBBB9", "light gray"), ("#8998A4", "gray")])
def test_color_names(spark, hexed, name):
    df = spark.createDataFrame([(hexed,)], "color string")
    assert sql(spark, f"SELECT {T.color_name('cr', 'cg', 'cb')} AS n FROM {T.with_channels(D, 't')} c", t=df)[0].n == name


def test_hex_and_caption(spark):
    df = spark.createDataFrame([("#3B82F6",), ("bad",), ("12345G",)], "s string")
    assert [tuple(r) for r in sql(spark, f"SELECT {', '.join(T.rgb(D, 's'))} FROM t", t=df)] == [(59, 130, 246), (0, 0, 0), (0, 0, 0)]
    el = boxes(spark, [("button", 700, 800, 200, 40, "#3B82F6")])
    said = sql(spark, f"SELECT {T.caption(D, 1000, 1000)} AS c FROM {T.with_channels(D, 'el')} e", el=el)[0].c
    assert "blue" in said and "button" in said and "bottom-right" in said


def test_merge_scales(spark):
    el = boxes(spark, [("card", 10, 10, 100, 50), ("card", 12, 11, 98, 49), ("button", 300, 300, 60, 24)])
    assert [r.k for r in sql(spark, B.ordered(D, f"({B.dedup(D, 'el', 55, replace=False)}) m"), el=el)] == [0, 2]


def test_diff(spark):
    a = boxes(spark, [("button", 48, 28, 90, 30, "#0000FF")])
    b = boxes(spark, [("button", 56, 30, 90, 30, "#FF0000"), ("card", 5, 500, 20, 20)])
    (r,) = sql(spark, B.diff_summary(D, "ea", "eb"), ea=a, eb=b)
    assert "1 element(s) moved" in r.summary and "changed color" in r.summary and "1 added" in r.summary
    assert sql(spark, B.diff_summary(D, "ea", "eb"), ea=a, eb=a)[0].summary == "no structural changes detected"


def test_layout(spark):
    side = boxes(spark, [("card", 10, 10, 100, 300), ("button", 200, 10, 200, 140), ("input", 200, 170, 200, 140)])
    got = {r.k: r for r in sql(spark, L.leaves(D, "el"), el=side)}
    assert len({r.path for r in got.values()}) == 3 and not any(r.in_region for r in got.values())
    tree = sorted(sql(spark, L.nodes(D, "el"), el=side), key=lambda r: r.id)
    assert [(r.type, r.parent, r.k) for r in tree] == [("card", None, 0), ("col", None, None), ("button", 1, 1), ("input", 1, 2)] or [(r.type, r.parent, r.k) for r in tree] == [("card", None, 0), ("row", None, None), ("button", 1, 1), ("input", 1, 2)]
    over = boxes(spark, [("icon", 10, 10, 30, 30), ("icon", 14, 14, 30, 30)])
    assert all(r.in_region for r in sql(spark, L.leaves(D, "el"), el=over))
    assert [(r.type, r.parent) for r in sorted(sql(spark, L.nodes(D, "el"), el=over), key=lambda r: r.id)] == [("region", None), ("icon", 0), ("icon", 0)]
    rows = boxes(spark, [("card", 50, 20, 300, 60), ("card", 50, 200, 300, 60)])
    assert [(r.type, r.parent, r.k) for r in sorted(sql(spark, L.nodes(D, "el"), el=rows), key=lambda r: r.id)] == [("card", None, 0), ("card", None, 1)]


def cut_tree(rows, axis, tries):
    """Groups of boxes by recursion: nested lists of (name, children) and box numbers."""
    if len(rows) == 1 or tries == 0:
        return [r[0] for r in rows]
    lo, size = (2, 4) if axis == "y" else (1, 3)
    rows = sorted(rows, key=lambda r: (r[lo], r[0]))
    groups, reach = [], None
    for r in rows:
        if reach is None or r[lo] - reach >= 12:
            groups.append([])
        groups[-1].append(r)
        reach = max(reach or 0, r[lo] + r[size]) if groups[-1] != [r] else r[lo] + r[size] if reach is None else max(reach, r[lo] + r[size])
    if len(groups) == 1:
        return cut_tree(rows, "x", tries - 1) if axis == "y" else [("region", [r[0] for r in rows])]
    out = []
    for g in groups:
        kids = cut_tree(g, "x" if axis == "y" else "y", tries - 1)
        out.append(kids[0] if len(kids) == 1 else ("row" if axis == "y" else "col", kids))
    return out


def test_layout_against_recursion(spark):
    """The node relation against a recursive cut, over random screens and all depths."""
    rng = np.random.default_rng(5)
    screens = {i: [(k, int(x), int(y), int(w), int(h)) for k, (x, y, w, h) in enumerate(zip(rng.integers(0, 900, n), rng.integers(0, 900, n), rng.integers(5, 160, n), rng.integers(5, 160, n), strict=True))] for i, n in enumerate(rng.integers(1, 30, 60))}
    # Nested cuts, deeper than the last.
    deep, x0, y0, side = [], 0, 0, 4096
    for i in range(9):
        side //= 2
        deep.append((i, x0, y0, side if i % 2 else 2 * side, side if not i % 2 else 2 * side))
        x0, y0 = (x0, y0 + side + 20) if not i % 2 else (x0 + side + 20, y0)
    screens[99] = [*deep, (9, x0, y0, 5, 5)]
    el = spark.createDataFrame([(i, k, "card", x, y, w, h, "", 0.5) for i, rows in screens.items() for k, x, y, w, h in rows], "image_id long, k long, type string, x long, y long, w long, h long, color string, score double")
    found = {}
    for r in sql(spark, L.nodes(D, "el"), el=el):
        found.setdefault(r.image_id, []).append(r)

    def told(rows, parent=None):
        return [r.k if r.k is not None else (r.type, told(rows, r.id)) for r in rows if r.parent == parent]

    def loose(tree):
        """Boxes of a region or of the last depth in any order, as ties are open."""
        return [(t[0], sorted(t[1]) if all(isinstance(x, int) for x in t[1]) else loose(t[1])) if isinstance(t, tuple) else t for t in tree]

    for i, rows in screens.items():
        got = told(sorted(found[i], key=lambda r: r.id))
        assert loose(got) == loose(cut_tree(rows, "y", 6)), i
        assert sorted(r.id for r in found[i]) == list(range(len(found[i])))


def over(a, b, share):
    w, h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    inter = max(w, 0) * max(h, 0)
    return inter / (a[3] * a[4] + b[3] * b[4] - inter) > share


def test_folds_against_loops(spark):
    """Duplicate suppression and greedy matches against plain loops."""
    rng = np.random.default_rng(2)

    def screen(n):
        return [(k, int(x), int(y), int(w), int(h), float(s)) for k, (x, y, w, h, s) in enumerate(zip(rng.integers(0, 60, n), rng.integers(0, 60, n), rng.integers(20, 60, n), rng.integers(20, 60, n), rng.integers(0, 5, n) / 5, strict=True))]

    one, two = ({i: screen(int(n)) for i, n in enumerate(rng.integers(0, 14, 40))} for _ in range(2))
    frame = lambda s: spark.createDataFrame([(i, *r[:1], "card", *r[1:5], "#000000", r[5]) for i, rows in s.items() for r in rows], "image_id long, k long, type string, x long, y long, w long, h long, color string, score double")
    kept = {}
    for r in sql(spark, B.dedup(D, "el"), el=frame(one)):
        kept.setdefault(r.image_id, set()).add(r.k)
    for i, rows in one.items():
        acc = []
        for b in rows:
            at = next((j for j, o in enumerate(acc) if over(o, b, 0.45)), None)
            if at is None:
                acc.append(b)
            elif b[5] > acc[at][5]:
                acc[at] = b
        assert kept.get(i, set()) == {b[0] for b in acc}, i
    want = set()
    for i in one:
        used = set()
        for a in one[i]:
            at = next((b[0] for b in two[i] if b[0] not in used and over(a, b, 0.5)), None)
            used.add(at)
            want.add((i, a[0], at))
        want |= {(i, None, b[0]) for b in two[i] if b[0] not in used}
    assert {(r.image_id, r.a_k, r.b_k) for r in sql(spark, B.pairs(D, "ea", "eb"), ea=frame(one), eb=frame(two))} == want


def test_chain(spark):
    lines = sql(spark, L.chain(D, "el"), el=boxes(spark, [("card", 0, 0, 100, 50), ("button", 10, 30, 60, 20)]))
    assert [r.line for r in lines] == ["  N0[card 100x50]", "  N1([button 60x20])"] and lines[1].link == "  N0 --> N1"


def test_config(tmp_path):
    assert config.Config(1, max_pixels=0, detector=config.Detector(min_area=0), color=config.Color(k=999), preprocess=config.Preprocess(-5)).normalized() == config.Config(color=config.Color(k=16))
    p = tmp_path / "c.json"
    p.write_text('{"max_side": 512, "detector": {"canny_low": 30}}')
    got, path, error = config.load(str(p))
    assert (got.max_side, got.detector.canny_low, got.detector.canny_high, path, error) == (512, 30, 150, str(p), "")
    p.write_text('{"detector": {"canny_low": 300}}')
    assert config.load(str(p))[0] == config.Config() and config.load(str(p))[2]
    assert config.load(str(tmp_path / "none"))[2]


def canvas(h, w, value=255):
    return np.full((h, w, 3), value, np.uint8)


def test_kernels_match_plans(spark):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (48, 64, 3), np.uint8)
    rgb[10:30, 8:40] = (20, 90, 200)
    px = spark.createDataFrame([(1, y, x, *map(int, rgb[y, x])) for y in range(48) for x in range(64)], "image_id long, y long, x long, r long, g long, b long")
    px.createOrReplaceTempView("px_test")

    def plane(text, col="v"):
        out = np.zeros((48, 64), int)
        for r in spark.sql(text).collect():
            out[r.y, r.x] = r[col]
        return out

    g = K.gray(rgb)
    assert (plane(P.gray(D, "px_test")) == g).all()
    assert (plane(P.gaussian(D, "px_test")) == K.gaussian(g)).all()
    mag, turn = K.sobel(K.gaussian(g))
    assert (plane(P.sobel(D, "px_test"), "mag") == mag).all() and (plane(P.sobel(D, "px_test"), "dir") == turn).all()
    assert (plane(P.nms(D, "px_test")) == K.thin(mag, turn)).all()
    assert (plane(P.morph_close(D, "px_test")) == K.closed(np.where(g < 128, 255, 0), 1)).all()
    assert (plane(P.sauvola(D, "px_test")) == K.sauvola(g, 3)).all()
    assert spark.sql(P.otsu(D, "px_test")).first().cut == K.otsu(g)
    assert spark.sql(P.background(D, "px_test")).first().background == K.background(rgb)
    assert abs(spark.sql(P.blur_metric(D, "px_test")).first().metric - K.blur_metric(g)) < 1e-3


def flood(on):
    lab, n = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on), strict=True):
        if not lab[y, x]:
            n += 1
            todo = [(y, x)]
            lab[y, x] = n
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(on.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(on.shape[1], b + 2)):
                        if on[c, d] and not lab[c, d]:
                            lab[c, d] = n
                            todo.append((c, d))
    return lab, n


@pytest.mark.parametrize("share", [0.05, 0.3, 0.6])
def test_labels(share):
    on = np.random.default_rng(3).random((40, 50)) < share
    lab, n = K.labels(on)
    want, m = flood(on)
    assert n == m and (lab == want).all()


def test_images():
    img = canvas(9, 7)
    img[2:5, 1:6] = (1, 2, 3)
    png = I.encode_png(img)
    assert I.header(png) == (7, 9) and (I.decode_png(png) == img).all()
    assert I.refusal(20000, 5) and I.refusal(5000, 5000) and I.refusal(0, 4) and I.refusal(100, 100) is None
    tiff = lambda o: (b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0" + bytes([o, 0, 0, 0]))
    assert I.orientation_of(tiff(6)) == 6 and I.orientation_of(b"junk") == 0 and I.orientation_of(b"") == 0
    assert I.orientation_of(b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x08\0\0") == 8
    jpeg = b"\xff\xd8\xff\xe1" + (2 + 6 + len(tiff(3))).to_bytes(2, "big") + b"Exif\0\0" + tiff(3)
    assert I.orientation_of(I.exif_block(jpeg)) == 3
    wide = canvas(2, 4)
    assert I.rotated(wide, 2).shape[:2] == (2, 4) and I.rotated(wide, 6).shape[:2] == (4, 2)
    assert K.fitted(canvas(1000, 2000), 1024).shape[1] == 1024


def test_kernels():
    assert K.background(canvas(100, 100) * np.array([1, 0, 0], np.uint8)) == "#FF0000"
    blue = canvas(90, 120, 0)
    blue[..., 2] = 255
    first = K.dominant(blue)[0]
    assert np.linalg.norm([int(first[i : i + 2], 16) - v for i, v in ((1, 0), (3, 0), (5, 255))]) <= 12
    for c in ((255, 255, 255), (0, 0, 0), (59, 130, 246)):
        assert np.abs(K.from_lab(K.to_lab(np.array(c, np.uint8))).astype(int) - c).max() <= 2
    split = canvas(60, 100)
    split[:, :50] = 0
    ridge = K.thin(*K.sobel(K.gray(split)))
    assert 0 < len(set(np.nonzero(ridge)[1])) <= 3 and K.canny(K.gray(split), 50, 150).any()
    table = canvas(300, 400)
    for x in (50, 130, 210, 290):
        table[50:190, x : x + 2] = 0
    for y in (50, 120, 190):
        table[y : y + 2, 50:292] = 0
    t = K.tables(K.edge_map(table))[0]
    assert t["rows"] >= 2 and t["cols"] >= 3 and 30 <= t["x"] <= 70 and 30 <= t["y"] <= 70
    solid = canvas(300, 400)
    solid[100:160, 50:350] = 0
    assert all(x["rows"] * x["cols"] > 1 for x in K.tables(K.edge_map(solid)))


def files(spark, **images):
    return spark.createDataFrame([(k, bytearray(I.encode_png(v))) for k, v in images.items()], "path string, content binary")


def test_extract(spark):
    img = canvas(200, 300)
    img[50:90, 80:220] = 0
    box = canvas(300, 300)
    box[100:120, 100:120] = 0
    box[102:118, 102:118] = 255
    got = {r.path: r for r in E.extract(files(spark, rect=img, box=box, empty=canvas(100, 100)).unionAll(spark.createDataFrame([("bad", bytearray(b"junk"))], "path string, content binary"))).collect()}
    assert got["rect"].boxes and got["rect"].boxes[0].color.startswith("#") and [b.ord for b in got["rect"].boxes] == list(range(1, len(got["rect"].boxes) + 1))
    assert got["bad"].error and got["empty"].page_type == "general" and got["empty"].page_confidence == 0.4
    assert got["rect"].markdown.startswith("## Image Facts (general)\n- Size: 300x200 px\n- Page type: ") and "- Dominant colors: [#" in got["rect"].markdown and "- Background: #FFFFFF\n" in got["rect"].markdown
    assert [n.type for n in got["empty"].layout] == ["region"] and (got["empty"].layout[0].w, got["empty"].layout[0].h) == (got["empty"].width, got["empty"].height)
    assert got["bad"].markdown is None and got["bad"].layout is None and all(t.text.startswith("[") for r in got.values() for t in r.texts or [])
    assert any(b.type == "checkbox" for b in got["box"].boxes)
    none = E.extract(files(spark, rect=img), config.Config(detector=config.Detector(min_area=1 << 20))).first()
    assert not none.boxes and none.n_boxes == 0


def test_small_object_on_a_large_image(spark):
    img = canvas(900, 1600)
    img[600:616, 1200:1216] = 0
    r = E.extract(files(spark, small=img)).first()
    assert (r.width, r.height) == (1024, 576)
    assert any(abs(b.x + b.w / 2 - 773) < 24 and abs(b.y + b.h / 2 - 389) < 24 for b in r.boxes)


def noise(seed=12345):
    out = np.zeros((80, 80, 3), np.uint8)
    for y in range(80):
        for x in range(80):
            seed = (seed * 1103515245 + 12345) % 2**31
            out[y, x] = [(seed >> s) & 255 for s in (16, 8, 20)]
    return out


def test_noise_is_a_picture(spark):
    img = canvas(300, 300)
    img[60:140, 60:140] = noise()
    assert {b.type for b in E.extract(files(spark, n=img)).first().boxes} & {"avatar", "image"}


def outline(img, x, y, w, h):
    img[y : y + h, x : x + w] = 0
    img[y + 2 : y + h - 2, x + 2 : x + w - 2] = 255


def test_diagram(spark):
    plain = canvas(200, 400)
    outline(plain, 40, 80, 80, 40)
    outline(plain, 280, 80, 80, 40)
    arrow = plain.copy()
    arrow[99:102, 126:268] = 0
    for i in range(8):
        arrow[100 - i : 101 + i, 268 - i] = 0
    got = {r.path: r for r in E.extract(files(spark, arrow=arrow, plain=plain, empty=canvas(60, 60)), mode="diagram").collect()}
    assert all(r.mermaid.startswith("flowchart TD\n") and r.markdown.startswith("## Image Facts (diagram)") and f"```mermaid\n{r.mermaid}```\n" in r.markdown for r in got.values())
    assert "-->" in got["arrow"].mermaid and any(line.startswith("  N") and "-->" in line for line in got["arrow"].mermaid.split("\n"))
    assert got["empty"].mermaid == "flowchart TD\n  A[empty]\n"
    edges = K.edge_map(plain)
    assert all(abs(c["ax"] - c["bx"]) < 100 for c in K.connectors(edges))


def test_table_of_three_columns_and_two_rows():
    table = canvas(300, 400)
    for x in (50, 130, 210, 290):
        table[50:192, x : x + 2] = 0
    for y in (50, 120, 190):
        table[y : y + 2, 50:292] = 0
    assert [(t["rows"], t["cols"]) for t in K.tables(K.edge_map(table), suppress_subtables=True)][0] in ((2, 3), (5, 7), (4, 6))


def filtered(rows, n, kinds):
    """PNG's five filters, by their definition."""
    out = []
    for y, row in enumerate(rows):
        line = [kinds[y]]
        for i, v in enumerate(row):
            a, b, c = (int(row[i - n]) if i >= n else 0), (int(rows[y - 1][i]) if y else 0), (int(rows[y - 1][i - n]) if y and i >= n else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((int(v) - [0, a, b, (a + b) // 2, near][kinds[y]]) & 255)
        out.append(bytes(line))
    return b"".join(out)


def png(w, h, depth, kind, data, interlaced=0, extra=b""):
    import struct
    import zlib

    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_png_kinds():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    for top in (3, 5):  # without and with the filters that need the pixel before
        for kind, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
            px = rng.integers(0, 256, (11, 13, n))
            rows, kinds = px.reshape(11, -1).tolist(), rng.integers(0, top, 11).tolist()
            got = I.decode_png(png(13, 11, 8, kind, filtered(rows, n, kinds)))
            want = np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]
            if n in (2, 4):
                want = want * 257 * px[..., -1:] // 255 >> 8
            assert (got == want).all()
    wide = rng.integers(0, 65536, (4, 5, 3))
    assert (I.decode_png(png(5, 4, 16, 2, b"".join(b"\0" + r.astype(">u2").tobytes() for r in wide))) == wide >> 8).all()
    bits = rng.integers(0, 2, (3, 10))
    assert (I.decode_png(png(10, 3, 1, 0, b"".join(b"\0" + np.packbits(r.astype(np.uint8)).tobytes() for r in bits)))[..., 0] == bits * 255).all()
    index = rng.integers(0, 4, (3, 6))
    plte = struct.pack(">I", 12) + b"PLTE" + bytes(range(12)) + struct.pack(">I", zlib.crc32(b"PLTE" + bytes(range(12))))
    packed = b"".join(b"\0" + bytes([(r[0] << 6) | (r[1] << 4) | (r[2] << 2) | r[3], (r[4] << 6) | (r[5] << 4)]) for r in index)
    assert (I.decode_png(png(6, 3, 2, 3, packed, extra=plte)) == np.arange(12).reshape(4, 3)[index]).all()
    px = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    parts = [px[y::dy, x::dx] for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))]
    assert (I.decode_png(png(11, 9, 8, 2, b"".join(b"\0" + r.tobytes() for p in parts if p.size for r in p), interlaced=1)) == px).all()
    bomb = png(2, 2, 8, 0, b"\0" * 50_000_000)
    assert I.decode_png(bomb).shape == (2, 2, 3)
    with pytest.raises(ValueError):
        I.decode_png(png(20, 20, 8, 0, b"\0" * 30))


def test_jpeg_upright(spark, tmp_path):
    """A JPEG with an orientation of 6 is decoded by the source and set upright; a GIF, a PNG and junk beside it."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(300, 200, 1)
    paint = image.createGraphics()
    paint.setColor(jvm.java.awt.Color(255, 255, 255))
    paint.fillRect(0, 0, 300, 200)
    paint.setColor(jvm.java.awt.Color(0, 0, 0))
    paint.fillRect(30, 50, 160, 60)
    for kind in ("jpg", "gif"):
        jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / f"a.{kind}")))
    tiff = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    plain = (tmp_path / "a.jpg").read_bytes()
    (tmp_path / "a.jpg").write_bytes(plain[:2] + b"\xff\xe1" + (2 + len(tiff)).to_bytes(2, "big") + tiff + plain[2:])
    (tmp_path / "b.png").write_bytes(I.encode_png(canvas(50, 60)))
    (tmp_path / "c.jpeg").write_bytes(b"no image")
    got = {r.path.rpartition("/")[2]: r for r in E.extract(I.read(spark, str(tmp_path))).collect()}
    assert (got["a.jpg"].width, got["a.jpg"].height, got["a.jpg"].orientation) == (200, 300, 6) and got["a.jpg"].boxes and "EXIF orientation: 6 (auto-rotated)" in got["a.jpg"].markdown
    assert (got["a.gif"].width, got["a.gif"].height) == (300, 200) and got["a.gif"].boxes and got["b.png"].error is None and got["c.jpeg"].error
    # Clockwise by a quarter: what lay at (30..190, 50..110) lies at (90..150, 30..190).
    assert any(abs(b.x - 90) < 6 and abs(b.y - 30) < 6 and abs(b.w - 60) < 12 and abs(b.h - 160) < 12 for b in got["a.jpg"].boxes)


def test_compare_and_engine(spark):
    a, b = canvas(200, 300), canvas(200, 300)
    a[50:90, 80:220] = 0
    b[50:90, 80:220] = 0
    b[120:180, 20:80] = 0
    pair = lambda x: files(spark, p=x).withColumnRenamed("path", "pair")
    same = E.compare(pair(a), pair(a)).first()
    assert same.summary == "no structural changes detected" and same.a_boxes == same.b_boxes > 0 and not (same.added or same.moved)
    more = E.compare(pair(a), pair(b)).first()
    assert "added" in more.summary and more.added[0].w > 30 and more.b_boxes > more.a_boxes
    first = E.compare(pair(canvas(200, 300)), pair(b)).first()  # nothing on the first side
    assert first.summary.endswith(")") and " added (e.g. " in first.summary and len(first.added) == first.b_boxes and first.a_boxes == 0
    none = E.compare(pair(canvas(90, 90)), pair(canvas(90, 90))).first()
    assert (none.summary, none.a_boxes, none.b_boxes, none.added) == ("no structural changes detected", 0, 0, [])
    junk = spark.createDataFrame([("p", bytearray(b"junk"))], "pair string, content binary")
    for x, y, said in ((junk, pair(a), "decode a: "), (pair(a), junk, "decode b: "), (pair(a), junk.where("false"), "b: no file")):
        r = E.compare(x, y).first()
        assert r.error.startswith(said) and r.summary is None and r.removed is None
    ocr.register("fixed", lambda content: [(" a ", 1, 2, 3, 4, 0.5), (" ", 0, 0, 1, 1, 0.1)])
    (r,) = ocr.read_texts(files(spark, p=a), "fixed").collect()
    assert [t.text for t in r.texts] == ["a"] and ocr.ready("fixed") and not ocr.bundle_present(config.Ocr())
    lazy = ocr.LazyEngine(lambda o: (lambda content: [("b", 0, 0, 1, 1, 1.0)], None), config.Ocr(enabled=True))
    broken = ocr.LazyEngine(lambda o: 1 / 0, config.Ocr(enabled=True, lib_path="x"))
    assert lazy(b"")[0][0] == "b" and lazy.available() and broken(b"") == [] and not broken.available()
    assert not ocr.configure(config.Ocr(enabled=True), lambda o: (None, None), "none") and not ocr.ready("none")
    (r,) = E.extract(files(spark, p=a), engine="fixed").collect()
    (said,) = I.as_document(E.extract(files(spark, p=a)).select("path", "markdown", "n_boxes")).collect()
    assert said.value.startswith("## Image Facts") and "\n```json\n{" in said.value and I.as_json(spark.range(1)).first().value.replace(" ", "").replace("\n", "") == '{"id":0}'
    assert [t.text for t in r.texts] == ["a"] and "- Text content: OCR-read via ONNX PP-OCR (confidence per line)\n  - \"a\" at (1,2) 3x4 conf 0.50\n" in r.markdown


def test_stream(spark, tmp_path):
    from pixelloom.streaming.screens import extract_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(I.encode_png(canvas(60, 60)))
    extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_derived(spark):
    assert S.components(spark, SF).count() > 0 and S.pixels(spark, SF).count() > 0


def test_pixels_of_every_screen(spark):
    boxes = {}
    for c in S.components(spark, SF).collect():
        boxes.setdefault(c.image_id, []).append(c)
    want = {}
    for i, rows in boxes.items():
        img = np.full((S.PIX_H, S.PIX_W, 3), 255, int)
        for c in sorted(rows, key=lambda c: c.k):
            x, y, w, h = (v // S.SHRINK for v in (c.x, c.y, c.w, c.h))
            img[y : y + h + 1, x : x + w + 1] = ((c.k * 67 + i * 31) % 256, c.k * 131 % 256, i * 29 % 256)
        want[i] = img
    got = S.pixels(spark, SF).toPandas().sort_values(["image_id", "y", "x"])
    assert sorted(set(got.image_id)) == sorted(want) and len(got) == len(want) * S.PIX_H * S.PIX_W
    for i, part in got.groupby("image_id"):
        assert (part[["r", "g", "b"]].to_numpy().reshape(want[i].shape) == want[i]).all(), i


@pytest.mark.parametrize("name", ["hysteresis", "components", "kmeans_rounds", "merge_close", "tables"])
def test_plane_queries(spark, name):
    """Queries over planes against plain loops over the same screens."""
    from pixelloom.plans import registered as R

    px = S.pixels(spark, SF).toPandas().sort_values(["image_id", "y", "x"])
    screens = {i: part[["r", "g", "b"]].to_numpy(np.uint8).reshape(S.PIX_H, S.PIX_W, 3) for i, part in px.groupby("image_id")}
    got = {i: [] for i in screens}
    for r in R.queries()[name](spark, SF).collect():
        got[r.image_id].append(tuple(r)[1:])
    if name == "hysteresis":
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        want = {i: [] for i in screens}
        for i, y, x in con.execute(R.ORACLES[name]).fetchall():
            want[i].append((y, x))
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    for i, img in screens.items():
        if name == "components":
            lab, n = flood(K.closed(K.edge_map(img)) > 0)
            boxes_ = [(k, *(lambda y, x: (x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, len(x)))(*np.nonzero(lab == k + 1))) for k in range(n)]
            assert sorted(got[i]) == boxes_
        elif name == "kmeans_rounds":
            assert sum(r[-1] for r in got[i]) >= S.PIX_H * S.PIX_W and len(got[i]) == 5
        elif name == "merge_close":
            assert 1 <= len(got[i]) <= 5 and [r[2] for r in sorted(got[i])] == sorted((r[2] for r in got[i]), reverse=True)
        elif name == "tables":
            assert all(r[5] * r[6] > 1 for r in got[i])


@pytest.mark.parametrize("name", sorted(planes.PLANS) + ["hysteresis", "components", "kmeans_rounds", "merge_close", "tables"])
def test_only_boxes_travel(spark, name):
    """No plan makes pixels before its kernel: nothing to sort, to shuffle or to broadcast by pixel."""
    plan = (Q.queries() | R.queries())[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sequence(" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", sorted(planes.PLANS))
def test_odd_events(spark, tmp_path, name):
    """Ids that are missing, repeated or absent, screens without boxes, ids under 0: as the definition has it."""
    ids = [None, None, *range(-25, 3), 7, 7, 7, 15, 33, 33, *range(60, 80), 73, 73, *range(92, 99), 10_000_019]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got, want = Q.queries()[name](spark, str(tmp_path)), S.over_events(spark, str(tmp_path), Q.SQL[name](D))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    for name in (*planes.PLANS, "hysteresis", "components", "kmeans_rounds", "merge_close", "tables"):
        assert (Q.queries() | R.queries())[name](spark, str(tmp_path)).count() == 0


def test_stacks_are_like_single_planes():
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 4, (6, 40, 56, 3)).astype(np.uint8) * 80
    rgb[2], rgb[3, 8:30, 5:40] = 255, (20, 90, 200)
    g = K.gray(rgb)
    for f in (K.gaussian, lambda p: K.sobel(p)[0], lambda p: K.sobel(p)[1], lambda p: K.closed(p > 99), lambda p: K.sauvola(p, 3), K.laplacian, lambda p: K.canny(p, 50, 150)):
        assert (f(g) == np.stack([f(p) for p in g])).all()
    lab, n = K.labels(g > 99)
    assert n == sum(K.labels(p > 99)[1] for p in g)
    colors, which = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True)
    lab = K.to_lab(colors)
    centers, sizes = K.kmeans_stack(lab, which.reshape(len(rgb), -1), 5)
    for i in range(len(rgb)):
        c, m = K.kmeans(lab[which.reshape(len(rgb), -1)[i]], 5)
        assert (c == centers[i]).all() and (m == sizes[i]).all()


def test_tables_of_each_screen(spark):
    px = S.pixels(spark, SF).toPandas().sort_values(["image_id", "y", "x"])
    want = []
    for i, part in px.groupby("image_id"):
        big = part[["r", "g", "b"]].to_numpy(np.uint8).reshape(S.PIX_H, S.PIX_W, 3).repeat(8, axis=0).repeat(8, axis=1)
        want += [(i, k, *t.values()) for k, t in enumerate(K.tables(K.edge_map(big)))]
    assert sorted(map(tuple, R.tables(spark, SF).collect())) == want and want
