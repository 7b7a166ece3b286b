"""Settings of an extraction: defaults, overlay from JSON, clamps."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Detector:
    canny_low: int = 50
    canny_high: int = 150
    min_area: int = 200


@dataclass(frozen=True)
class Color:
    k: int = 5
    deltaE_merge: float = 12.0  # noqa: N815  the key of the files


@dataclass(frozen=True)
class Preprocess:
    blur_threshold: float = 80.0


@dataclass(frozen=True)
class Ocr:
    enabled: bool = False
    lib_path: str = ""
    det_path: str = ""
    rec_path: str = ""
    dict_path: str = ""
    det_max_side_len: int = 0
    thread_count: int = 0
    num_threads: int = 0


@dataclass(frozen=True)
class Config:
    max_side: int = 1024
    max_pixels: int = 12_000_000
    multiscale: bool = True
    detector: Detector = field(default_factory=Detector)
    color: Color = field(default_factory=Color)
    preprocess: Preprocess = field(default_factory=Preprocess)
    ocr: Ocr = field(default_factory=Ocr)

    def normalized(self) -> Config:
        """Values out of range become the default or the nearest that is allowed; the upper edge threshold stays within a byte."""
        d, ok = self.detector, lambda v, low, default: v if v >= low else default
        low = d.canny_low or 50
        high = d.canny_high if d.canny_high > low else min(255, low * 3)
        return replace(
            self,
            max_side=min(4096, ok(self.max_side, 64, 1024)),
            max_pixels=ok(self.max_pixels, 100_000, 12_000_000),
            detector=Detector(low, high, ok(d.min_area, 25, 200)),
            color=Color(min(16, ok(self.color.k, 1, 5)), self.color.deltaE_merge if self.color.deltaE_merge > 0 else 12.0),
            preprocess=Preprocess(self.preprocess.blur_threshold if self.preprocess.blur_threshold > 0 else 80.0),
            ocr=replace(self.ocr, **{k: max(0, getattr(self.ocr, k)) for k in ("det_max_side_len", "thread_count", "num_threads")}),
        )


def _overlay(base, values: dict):
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    changed = {}
    for key, value in values.items():
        if key not in known:
            continue
        now = known[key]
        if isinstance(value, dict):
            changed[key] = _overlay(now, value)
        elif isinstance(now, bool) != isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(now, float) else type(now)):
            raise ValueError(f"{key}: {value!r} is not a {type(now).__name__}")
        elif key.startswith("canny") and not 0 <= value <= 255:
            raise ValueError(f"{key}: {value} is not a byte")
        else:
            changed[key] = value
    return replace(base, **changed)


def load(explicit: str = "", name: str = "pixelloom.json") -> tuple[Config, str, str]:
    """(config, path, error): the file named, or else the first of this folder's and the home's; what it leaves out keeps its default. A file that can't be used gives the defaults and an error."""
    for path in [explicit] if explicit else [name, os.path.join(str(Path.home()), name)]:
        try:
            text = Path(path).read_text()
        except FileNotFoundError as e:
            if explicit:
                return Config(), "", f"read config {path}: {e}"
            continue
        except OSError as e:
            if explicit:
                return Config(), "", f"read config {path}: {e}"
            continue
        try:
            return _overlay(Config(), json.loads(text)).normalized(), path, ""
        except (ValueError, AttributeError, TypeError) as e:
            return Config(), path, f"parse config {path}: {e}"
    return Config().normalized(), "", ""
