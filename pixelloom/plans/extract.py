"""Extraction and comparison: one Arrow stage over pixels, then a relational tail over boxes.

The pixel stage gives one row for each image, with its components on each scale as an
array, so no image's planes leave their task. The tail's windows and folds are
keyed by image; describing is selecting the markdown column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Detector
from ..functions import text as T
from ..functions.text import SPARK as D
from ..operators import boxes as B
from ..operators import kernels as K
from ..operators import layout as L
from ..shipping import materialized, ship
from ..sources import images as I
from .ocr import read_texts

_COMP = "struct<k:long,x:long,y:long,w:long,h:long,ed:double,ring:double,cv:double,color:string>"
_TABLE = "struct<x:int,y:int,w:int,h:int,rows:int,cols:int>"
_LINK = "struct<ax:int,ay:int,bx:int,by:int>"
PIXELS = f"path string, error string, width long, height long, orientation int, background string, dominant array<string>, tables array<{_TABLE}>, connectors array<{_LINK}>, scales array<struct<prio:int,factor:double,sw:long,sh:long,comps:array<{_COMP}>>>"
#: The number of the run that placeholders are taken from: the base scale with the default settings, whatever a user's are.
GUESSES = 9


def scale_sizes(w: int, h: int, max_side: int) -> list[tuple[int, int]]:
    """(priority, longest side) of the runs over a source of w x h: a larger one where it has pixels to spare, the base, a half."""
    base_w = K.fitted_size(w, h, max_side)[0]
    out = []
    hi = min(2 * max_side, 2048, max(w, h))
    if max(w, h) >= max_side * 3 // 2 and hi > max_side and K.fitted_size(w, h, hi)[0] > base_w:
        out.append((0, hi))
    out.append((1, max_side))
    if K.fitted_size(w, h, max_side // 2)[0] < base_w:
        out.append((2, max_side // 2))
    return out


def _failed(path: str, error: str) -> tuple:
    return path, error, 0, 0, 0, None, None, None, None, []


def _pixel_row(path: str, content: bytes, image: object, cfg: Config, mode: str, plain: bool) -> tuple:
    try:
        rgb = I.pixels_of(content, image, cfg.max_pixels)
    except Exception as e:  # noqa: BLE001  a file that can't be read is a row with an error
        return _failed(path, str(e) or type(e).__name__)
    low, high = cfg.detector.canny_low, cfg.detector.canny_high
    turn = 0 if plain else I.orientation_of(I.exif_block(content))
    if not plain:
        rgb = np.ascontiguousarray(I.rotated(rgb, turn))
        rgb = K.preprocessed(rgb, mode, cfg.preprocess.blur_threshold)
        if rgb.shape[0] * rgb.shape[1] > 4 * cfg.max_pixels:
            return _failed(path, "too many pixels after preprocessing")
    base = K.fitted(rgb, cfg.max_side)
    bh, bw = base.shape[:2]
    base_edges = K.edge_map(base, low, high)
    scales = []
    for prio, side in scale_sizes(rgb.shape[1], rgb.shape[0], cfg.max_side) if cfg.multiscale and not plain else [(1, cfg.max_side)]:
        img = base if prio == 1 else K.fitted(rgb, side)
        edges = base_edges if prio == 1 else K.edge_map(img, low, high)
        scales.append({"prio": prio, "factor": bw / img.shape[1], "sw": img.shape[1], "sh": img.shape[0], "comps": K.components(img, edges)})
    if not plain and cfg.detector != Detector():
        d = Detector()
        scales.append({"prio": GUESSES, "factor": 1.0, "sw": bw, "sh": bh, "comps": K.components(base, K.edge_map(base, d.canny_low, d.canny_high))})
    links = K.connectors(base_edges) if mode == "diagram" else []
    colors = [] if plain else K.dominant(base, cfg.color.k, cfg.color.k, cfg.color.deltaE_merge)
    return path, None, bw, bh, turn, K.background(base), colors, [] if plain else K.tables(base_edges), links, scales


def pixel_stage(files: DataFrame, cfg: Config, mode: str = "general", plain: bool = False) -> DataFrame:
    """Files (path, content, and image where the source has decoded them) → PIXELS. plain: no orientation, preprocessing, scales, colours or tables, as comparisons want."""
    ship(files.sparkSession)
    names = [f.split(" ")[0] for f in "path,error,width,height,orientation,background,dominant,tables,connectors,scales".split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["path"], pdf["content"], pdf["image"], strict=True)
            yield pd.DataFrame([_pixel_row(path, content, image, cfg, mode, plain) for path, content, image in rows], columns=names)

    image = F.col("image") if "image" in files.columns else F.lit(None).cast(I.DECODED).alias("image")
    return files.select("path", "content", image).mapInPandas(run, PIXELS)


def _sql(spark: SparkSession, sql: str, **sources: DataFrame) -> DataFrame:
    """SQL over data frames by name."""
    heads = ", ".join(f"{name} AS (SELECT * FROM {{{name}__df}})" for name in sources)
    body = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH {heads} SELECT * FROM ({body}) whole", **{f"{k}__df": v for k, v in sources.items()})


def detected(pixels: DataFrame, cfg: Config, guesses: bool = False) -> DataFrame:
    """Boxes in base coordinates over all scales, in the order in which merging takes them: (image_id, k, type, x, y, w, h, color, score). guesses: those of the run for placeholders."""
    spark = pixels.sparkSession
    own = F.col("prio") == GUESSES if guesses else F.col("prio") != GUESSES
    flat = pixels.where("error IS NULL").select(F.col("path"), F.explode("scales").alias("s")).select("path", "s.*").where(own)
    comps = flat.select("path", "prio", "factor", "sw", "sh", F.explode("comps").alias("c")).select(F.struct("path", "prio", "factor").alias("image_id"), "sw", "sh", "c.*")
    area = Detector().min_area if guesses else cfg.detector.min_area
    el = _sql(spark, f"SELECT image_id, k, {T.classify('sw')} AS type, x, y, w, h, color, {T.score('sw', 'sh')} AS score FROM comps WHERE {T.kept('sw', 'sh', area)}", comps=comps)
    kept = _sql(spark, B.ordered(D, f"({B.dedup(D, 'el')}) dd", B.DETECTED), el=el)
    mapped = ", ".join(f"cast({T.scaled(D, c, 'image_id.factor')} AS bigint) AS {c}" for c in "xywh")
    return _sql(spark, f"SELECT image_id.path AS image_id, cast(image_id.prio * 1000 + ord AS bigint) AS k, type, {mapped}, color, score FROM kept", kept=kept)


def merged(boxes: DataFrame) -> DataFrame:
    """One list of boxes for each image, in reading order (ord)."""
    return _sql(boxes.sparkSession, B.ordered(D, f"({B.dedup(D, 'bx', 55, replace=False)}) m", B.MERGED), bx=boxes)


def placeholders(pixels: DataFrame, cfg: Config, boxes: DataFrame) -> DataFrame:
    """(image_id, i, words, x, y, w, h, conf): what shapes suggest, over the boxes of the base scale under the default settings."""
    spark = pixels.sparkSession
    if cfg.detector == Detector():  # the base scale's own boxes, before scales are merged
        boxes = boxes.where("k >= 1000 AND k < 2000")
    else:
        boxes = detected(pixels, cfg, guesses=True)
    return _sql(spark, f"SELECT image_id, k AS i, {T.guess_text()} AS words, x, y, w, h, cast(0 AS double) AS conf FROM bx WHERE {T.is_placeholder()}", bx=boxes)


def _as_lists(df: DataFrame, name: str, order: str, *fields: str) -> DataFrame:
    """(image_id, name): rows of an image as an array of structs, in order."""
    return df.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("s")))), lambda z: z["s"]).alias(name))


def extract(files: DataFrame, cfg: Config | None = None, mode: str = "general", engine: str | None = None) -> DataFrame:
    """One row for each file: path, error, width, height, orientation, mode, n_boxes, page_type, page_confidence, boxes, grids, tables, dominant, background, layout (nodes in preorder), texts, mermaid (in mode diagram), markdown.

    engine: the name of a registered text engine; an image of which it reads nothing has placeholders.
    """
    spark, cfg = files.sparkSession, (cfg or Config()).normalized()
    pixels = materialized(pixel_stage(files, cfg, mode), "pixels")
    meta = pixels.select(F.col("path").alias("image_id"), "width", "height", "background", "orientation", "error", F.lit(mode).alias("mode"), F.array_join("dominant", " ").alias("dominant_said"))
    size = meta.select("image_id", F.col("width").alias("pw"), F.col("height").alias("ph"))
    found = materialized(detected(pixels, cfg), "detected")
    ob = _sql(spark, f"SELECT image_id, ord AS k, type, x, y, w, h, color, score, ord, {T.caption(D, 'pw', 'ph')} AS caption FROM {T.with_channels(D, '(SELECT * FROM bx JOIN sz USING (image_id)) j')} c", bx=merged(found), sz=size)
    ob = materialized(ob, "boxes")
    guessed = placeholders(pixels, cfg, found)
    if engine:
        read = read_texts(files, engine).select(F.col("path").alias("image_id"), F.posexplode("texts").alias("i", "t"))
        read = materialized(read.select("image_id", F.col("i").cast("long").alias("i"), F.col("t.text").alias("words"), *[F.col(f"t.{c}").cast("long").alias(c) for c in "xywh"], "t.conf"), "texts")
        guessed = read.unionByName(guessed.join(read.select("image_id").distinct(), "image_id", "left_anti"))
    texts = materialized(guessed, "words")
    pages = _sql(spark, B.page_type(D, "pg", "ob", "i.width", "i.height"), pg=meta, ob=ob)
    described = meta.join(pages, "image_id")
    if mode == "diagram":
        described = described.join(diagram(ob, pixels), "image_id", "left").withColumn("mermaid", F.coalesce("mermaid", F.lit("flowchart TD\n  A[empty]\n")))
    else:
        described = described.withColumn("mermaid", F.lit(None).cast("string"))
    described = materialized(described.withColumnRenamed("dominant_said", "dominant"), "pages")
    grids = materialized(_sql(spark, B.grids(D, "ob"), ob=ob), "grids")
    rows = pixels.select(F.col("path").alias("image_id"), F.posexplode("tables").alias("i", "t")).select("image_id", F.col("i").cast("long").alias("i"), "t.x", "t.y", "t.w", "t.h", F.col("t.rows").alias("n_rows"), F.col("t.cols").alias("n_cols"))
    marked = _sql(spark, L.markdown(D, "ds", "ob", "gr", "tb", "tx"), ds=described, ob=ob, gr=grids, tb=rows, tx=texts)
    nodes = _sql(spark, f"SELECT n.*, o.ord, o.caption FROM ({L.nodes(D, 'ob')}) n LEFT JOIN ob o ON o.image_id = n.image_id AND o.k = n.k", ob=ob)
    parts = [
        _as_lists(ob, "boxes", "ord", "ord", "type", "x", "y", "w", "h", "color", "score", "caption"),
        _as_lists(grids, "grids", "cell", "cell", "cells", "grid_cols", "grid_rows"),
        _as_lists(nodes, "layout", "id", "id", "parent", "type", "ord", "caption", "x", "y", "w", "h"),
        _as_lists(texts, "texts", "i", F.col("words").alias("text"), "x", "y", "w", "h", "conf"),
    ]
    out = described.join(marked, "image_id")
    for part in parts:
        out = out.join(part, "image_id", "left")
    # A screen without boxes is one region.
    empty = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit("region").alias("type"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("caption"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("width").alias("w"), F.col("height").alias("h")))
    rest = pixels.select(F.col("path").alias("image_id"), "dominant", "tables")
    out = out.withColumn("layout", F.when(F.col("error").isNull(), F.coalesce("layout", empty))).drop("dominant")
    for c in ("markdown", "page_type", "confidence", "mermaid"):
        out = out.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    return out.join(rest, "image_id").withColumnRenamed("image_id", "path").withColumnRenamed("confidence", "page_confidence")


def diagram(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, mermaid): nodes, then edges of connectors and bars in the order found, each pair once, or the hierarchy where there are none. boxes: k is the place in reading order."""
    spark = boxes.sparkSession
    links = pixels.select(F.col("path").alias("image_id"), F.posexplode("connectors").alias("p", "c"))
    ends = links.select("image_id", (F.col("p") * 2).cast("long").alias("p"), F.col("c.ax").alias("px"), F.col("c.ay").alias("py")).unionAll(links.select("image_id", (F.col("p") * 2 + 1).cast("long").alias("p"), F.col("c.bx").alias("px"), F.col("c.by").alias("py")))
    near = _sql(spark, B.nearest_box(D, "pts", "bx"), pts=ends, bx=boxes)
    arrows = _sql(spark, "SELECT a.image_id, cast(a.p AS bigint) AS own, a.k AS src, b.k AS dst FROM nb a JOIN nb b ON a.image_id = b.image_id AND b.p = a.p + 1 WHERE a.p % 2 = 0 AND a.k <> b.k", nb=near)
    bars = _sql(spark, f"SELECT image_id, own + 1000000000 AS own, src, dst FROM ({B.bar_edges(D, 'bx')}) z", bx=boxes)
    edges = _sql(spark, B.distinct_edges(D, "(SELECT * FROM ar UNION ALL SELECT * FROM br) u"), ar=arrows, br=bars)
    nodes = _sql(spark, L.graph_nodes(D, "bx"), bx=boxes)
    tree = _sql(spark, L.hierarchy(D, f"(SELECT n.*, n.k AS ord FROM ({L.nodes(D, 'bx')}) n) t"), bx=boxes)

    def lines(df: DataFrame, line: Column, order: str, name: str) -> DataFrame:
        told = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(line, F.lit("\n")).alias("t")))), lambda z: z["t"])
        return df.groupBy("image_id").agg(F.array_join(told, "").alias(name))

    drawn = lines(edges, F.concat(F.lit("  N"), F.col("src") - 1, F.lit(" --> N"), F.col("dst") - 1), "own", "edges")
    out = lines(nodes, F.col("line"), "ord", "nodes").join(drawn, "image_id", "left").join(lines(tree, F.col("line"), "id", "tree"), "image_id", "left")
    return out.select("image_id", F.concat(F.lit("flowchart TD\n"), "nodes", F.coalesce("edges", "tree")).alias("mermaid"))


def compare(files_a: DataFrame, files_b: DataFrame, cfg: Config | None = None, side: int = 512) -> DataFrame:
    """Pairs of files (pair, content) → one row a pair: pair, error, summary, added, removed, moved, color_changed (boxes, or from and to), a_boxes, b_boxes. Sides at 512 pixels, one scale, no preprocessing; where a file is missing or can't be read there is an error and nothing else."""
    spark, cfg = files_a.sparkSession, replace((cfg or Config()).normalized(), max_side=side, multiscale=False)

    def pixels(files: DataFrame) -> DataFrame:
        image = [F.col("image")] if "image" in files.columns else []
        return materialized(pixel_stage(files.select(F.col("pair").cast("string").alias("path"), "content", *image), cfg, plain=True), "side")

    a, b = pixels(files_a), pixels(files_b)
    met = a.select(F.col("path").alias("pair"), F.lit(True).alias("in_a"), F.col("error").alias("error_a")).join(b.select(F.col("path").alias("pair"), F.lit(True).alias("in_b"), F.col("error").alias("error_b")), "pair", "full")
    wrong = [F.when(F.col(f"in_{s}").isNull(), F.lit(f"{s}: no file")).otherwise(F.concat(F.lit(f"decode {s}: "), f"error_{s}")) for s in "ab"]
    status = met.select("pair", F.nullif(F.concat_ws("; ", *wrong), F.lit("")).alias("error"))
    found = materialized(_sql(spark, B.changes(D, "ea", "eb"), ea=detected(a, cfg), eb=detected(b, cfg)), "changes")
    told = _sql(spark, B.summary(D, "ch"), ch=found)
    box = {s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("type", "x", "y", "w", "h", "color")]) for s in "ab"}
    both = F.struct(box["a"].alias("from"), box["b"].alias("to"))
    what = {"added": (box["b"], "b_k"), "removed": (box["a"], "a_k"), "moved": (both, "a_k"), "color_changed": (both, "a_k")}
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col(c), F.struct(F.col(k).alias("o"), v.alias("s"))))), lambda z: z["s"]).alias(c) for c, (v, k) in what.items()]
    listed = found.groupBy("image_id").agg(*lists, F.count("a_k").alias("a_boxes"), F.count("b_k").alias("b_boxes"))
    out = status.join(told.withColumnRenamed("image_id", "pair"), "pair", "left").join(listed.withColumnRenamed("image_id", "pair"), "pair", "left")
    fine = F.col("error").isNull()
    given = {"summary": F.lit("no structural changes detected"), "a_boxes": F.lit(0), "b_boxes": F.lit(0)}
    columns = [F.when(fine, F.coalesce(c, given[c]) if c in given else F.coalesce(c, F.array())).alias(c) for c in ("summary", *what, "a_boxes", "b_boxes")]
    return out.select("pair", "error", *columns)


def describe(files: DataFrame, cfg: Config | None = None, mode: str = "general") -> DataFrame:
    return extract(files, cfg, mode).select("path", "markdown")
