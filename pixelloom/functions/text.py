"""Scalar functions as SQL text that Spark evaluates inside whole-stage code generation.

Arguments and results are SQL expressions. Where engines write a thing
differently the function takes a Dialect, so that a query's check in another engine
uses the very same definition of thresholds and names.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def div(self, a: object, b: object) -> str:
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def hex2(self, n: str) -> str:
        return f"format_string('%02X', {n})" if self.name == "spark" else f"format('{{:02X}}', {n})"

    def unhex(self, s: str) -> str:
        return f"cast(conv({s}, 16, 10) AS int)" if self.name == "spark" else f"CAST('0x' || {s} AS INT)"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} rlike '{pattern}')" if self.name == "spark" else f"regexp_matches({s}, '{pattern}')"

    def dec2(self, v: str) -> str:
        return f"format_string('%.2f', {v})" if self.name == "spark" else f"printf('%.2f', {v})"

    def int(self, v: str) -> str:
        """Towards zero."""
        return f"cast({v} AS int)" if self.name == "spark" else f"CAST(trunc({v}) AS INT)"

    def struct(self, **fields: str) -> str:
        if self.name == "spark":
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def fn(self, args: str, body: str) -> str:
        return f"({args}) -> {body}" if self.name == "spark" else f"lambda {args}: {body}"

    def call(self, spark: str, duckdb: str) -> str:
        return spark if self.name == "spark" else duckdb


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")
HEX = "^#?[0-9A-Fa-f]{6}$"
# Anchors of named colours, phrases of element types.
COLORS = (("black", 0, 0, 0), ("white", 255, 255, 255), ("red", 215, 45, 45), ("green", 45, 160, 60), ("blue", 45, 85, 220), ("yellow", 230, 200, 40), ("orange", 240, 140, 30), ("purple", 130, 60, 180), ("pink", 230, 120, 170), ("brown", 140, 90, 50))
PHRASES = (("input", "input field"), ("card", "panel"), ("image", "image region"), ("text_block", "text line"))


def channel(d: Dialect, s: str, i: int) -> str:
    """Red, green or blue (0, 1, 2) of a colour string; 0 if any digit is bad."""
    return f"(CASE WHEN {d.matches(s, HEX)} THEN {d.unhex(f'substr(right({s}, 6), {2 * i + 1}, 2)')} ELSE 0 END)"


def rgb(d: Dialect, s: str) -> list[str]:
    return [channel(d, s, i) for i in range(3)]


def luminance(r: str, g: str, b: str) -> str:
    return f"(cast(0.2126 AS double) * {r} + cast(0.7152 AS double) * {g} + cast(0.0722 AS double) * {b})"


def distance2(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(a, b, strict=True)) + ")"


def color_name(r: str, g: str, b: str) -> str:
    """The name of a colour: grey levels by luminance, else the nearest anchor, the first of equals."""
    spread, lum = f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))", luminance(r, g, b)
    to = [distance2([r, g, b], [str(x) for x in c[1:]]) for c in COLORS]
    nearest = f"least({', '.join(to)})"
    named = " ".join(f"WHEN {x} = {nearest} THEN '{c[0]}'" for x, c in zip(to, COLORS, strict=True))
    grey = f"CASE WHEN {lum} < 40 THEN 'black' WHEN {lum} > 220 THEN 'white' WHEN {lum} > 160 THEN 'light gray' WHEN {lum} < 80 THEN 'dark gray' ELSE 'gray' END"
    return f"(CASE WHEN {spread} < 30 THEN {grey} WHEN {nearest} > 40000 THEN 'gray' {named} END)"


def horizontal(d: Dialect, width: int | str, b: str = "") -> str:
    cx = f"(cast({b}x + {d.div(f'{b}w', 2)} AS double) / {width})"
    return f"(CASE WHEN {cx} < 0.36 THEN 'left' WHEN {cx} > 0.64 THEN 'right' ELSE 'center' END)"


def vertical(d: Dialect, height: int | str, b: str = "") -> str:
    cy = f"(cast({b}y + {d.div(f'{b}h', 2)} AS double) / {height})"
    return f"(CASE WHEN {cy} < 0.33 THEN 'top' WHEN {cy} > 0.67 THEN 'bottom' ELSE 'middle' END)"


def caption(d: Dialect, width: int | str, height: int | str) -> str:
    """Colour, phrase, size and place of a box (type, x, y, w, h, color, and the colour's channels cr, cg, cb)."""
    share = f"(cast(w * h AS double) / ({width} * {height}))"
    h, v = horizontal(d, width), vertical(d, height)
    phrase = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PHRASES) + " ELSE type END"
    tint = f"CASE WHEN color <> '' THEN {color_name('cr', 'cg', 'cb')} END"
    place = f"CASE WHEN {h} <> 'center' OR {v} <> 'middle' THEN concat('at ', {v}, '-', {h}) ELSE 'at center' END"
    size = f"CASE WHEN {share} < 0.01 THEN 'small' WHEN {share} > 0.15 THEN 'large' ELSE 'medium' END"
    return f"concat_ws(' ', {tint}, {phrase}, concat(cast(w AS string), 'x', cast(h AS string)), {size}, {place})"


def with_channels(d: Dialect, source: str) -> str:
    """source with the channels of color, as columns of their own, so that expressions over them stay small."""
    return f"(SELECT *, {', '.join(f'{c} AS {n}' for c, n in zip(rgb(d, 'color'), ('cr', 'cg', 'cb'), strict=True))} FROM {source})"


def classify(width: int | str) -> str:
    """The element type of a component (w, h, ed, ring, cv; the last three in hundredths), first rule that holds."""
    ar, ed, ring, cv = "(cast(w AS double) / h)", "(cast(ed AS double) / 100)", "(cast(ring AS double) / 100)", "(cast(cv AS double) / 100)"
    rules = (
        ("checkbox", f"w BETWEEN 12 AND 28 AND h BETWEEN 12 AND 28 AND {ar} > 0.7 AND {ar} < 1.4 AND {ring} > 0.45 AND {cv} < 0.02"),
        ("icon", f"w < 40 AND h < 40 AND {ed} > 0.15"),
        ("avatar", f"{ar} BETWEEN 0.8 AND 1.25 AND w BETWEEN 30 AND 140 AND h BETWEEN 30 AND 140 AND {cv} > 0.04"),
        ("input", f"{ar} > 3.2 AND h > 14 AND h < 70 AND {ed} < 0.3"),
        ("button", f"{ar} > 1.4 AND {ar} < 6 AND w > 50 AND h > 20 AND h < 85 AND w * h < 40000 AND {ed} > 0.08 AND {ed} < 0.5"),
        ("image", f"{ar} < 1.25 AND w > 35 AND h > 35 AND w < 400 AND h < 400 AND {ed} < 0.4"),
        ("card", f"w * 2 > {width} AND h > 50"),
        ("text_block", f"{ed} > 0.02 AND {ed} < 0.25 AND h < 35 AND w > 25"),
    )
    return "(CASE " + " ".join(f"WHEN {r} THEN '{t}'" for t, r in rules) + " ELSE 'card' END)"


def score(width: int | str, height: int | str) -> str:
    return f"round(least(cast(1 AS double), cast(w * h AS double) / ({width} * {height}) * 0.5 + cast(ed AS double) / 100 * 0.5), 9)"


def kept(width: int | str, height: int | str, min_area: int) -> str:
    """Whether a component may be an element: a 20000th of the canvas and min_area at least, nine tenths of it at most."""
    canvas = f"({width} * {height})"
    return f"(w >= 12 AND h >= 10 AND w * h >= {min_area} AND (w * h + 1) * 20000 > {canvas} AND w * h * 10 <= {canvas} * 9)"


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"


def iou_over(a: str, b: str, percent: int) -> str:
    """Whether intersection over union is over so many hundredths, in integers."""
    return f"({inter(a, b)} * 100 > {percent} * ({a}w * {a}h + {b}w * {b}h - {inter(a, b)}))"


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {inter(a, b)} = 0 THEN cast(0 AS double) ELSE cast({inter(a, b)} AS double) / ({a}w * {a}h + {b}w * {b}h - {inter(a, b)}) END)"


def guess_text() -> str:
    return "(CASE WHEN type = 'button' THEN '[button]' WHEN type = 'input' THEN '[input]' WHEN type = 'text_block' THEN '[text]' WHEN w > 3 * h THEN '[text line]' ELSE '[block]' END)"


def was_read(words: str) -> str:
    """Whether a text is one that an engine has read, not a placeholder."""
    return f"({words} NOT LIKE '[%')"


def is_placeholder() -> str:
    return "(type = 'text_block' OR (h BETWEEN 14 AND 40 AND w > 30 AND w < 600))"


def scaled(d: Dialect, v: str, factor: str) -> str:
    return d.int(f"floor({v} * cast({factor} AS double) + 0.5)")


def linear(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.04045 THEN {c} / cast(12.92 AS double) ELSE power(({c} + cast(0.055 AS double)) / cast(1.055 AS double), cast(2.4 AS double)) END)"


def encoded(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.0031308 THEN cast(12.92 AS double) * {c} ELSE cast(1.055 AS double) * power({c}, cast(1 AS double) / cast(2.4 AS double)) - cast(0.055 AS double) END)"


def lab_f(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN power({t}, cast(1 AS double) / 3) ELSE cast(7.787 AS double) * {t} + cast(16 AS double) / 116 END)"


def lab_f_inverse(t: str) -> str:
    return f"(CASE WHEN {t} > 0.206893 THEN {t} * {t} * {t} ELSE ({t} - cast(16 AS double) / 116) / cast(7.787 AS double) END)"


# sRGB to XYZ (D65) and back.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)


def lab_steps(r: str, g: str, b: str) -> list[dict[str, str]]:
    """Columns to add, step by step, to get lab_l, lab_a and lab_b from channels of 0 to 255."""
    lin = {f"lin{i}": linear(f"(cast({c} AS double) / 255)") for i, c in enumerate((r, g, b))}
    xyz = {f"xyz{i}": "((" + " + ".join(f"lin{j} * cast({m} AS double)" for j, m in enumerate(row)) + f") / cast({WHITE[i]} AS double))" for i, row in enumerate(TO_XYZ)}
    f = {f"f{i}": lab_f(f"xyz{i}") for i in range(3)}
    return [lin, xyz, f, {"lab_l": "116 * f1 - 16", "lab_a": "500 * (f0 - f1)", "lab_b": "200 * (f1 - f2)"}]


def rgb_steps(d: Dialect, lum: str, a: str, b: str) -> list[dict[str, str]]:
    """Columns to add, step by step, to get out0, out1 and out2, channels of 0 to 255, from Lab."""
    fy = f"(({lum} + 16) / cast(116 AS double))"
    f = {"g0": f"{fy} + {a} / cast(500 AS double)", "g1": fy, "g2": f"{fy} - {b} / cast(200 AS double)"}
    xyz = {f"back{i}": f"{lab_f_inverse(f'g{i}')} * cast({WHITE[i]} AS double)" for i in range(3)}
    raw = {f"raw{i}": "(" + " + ".join(f"back{j} * cast({m} AS double)" for j, m in enumerate(row)) + ")" for i, row in enumerate(FROM_XYZ)}
    return [f, xyz, raw, {f"out{i}": d.int(f"floor(least(cast(1 AS double), greatest(cast(0 AS double), {encoded(f'greatest(raw{i}, cast(0 AS double))')})) * 255 + 0.5)") for i in range(3)}]
