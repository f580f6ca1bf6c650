"""Configuration: files with paths, specifications with their checks, overlays, functions by name."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.vocabulary import MUSCLES


class Config(dict):
    """A JSON file's values; paths in it are relative to its root, and an environment variable may replace any of them."""

    def __init__(self, path: str | Path, root: str | Path | None = None, prefix: str = "CORVID_"):
        self.root, self.prefix = Path(root or Path(path).resolve().parent), prefix
        super().__init__(json.loads(Path(path).read_text(encoding="utf-8")))

    def value(self, key: str):
        return os.environ.get(f"{self.prefix}{key.upper()}", self[key])

    def path(self, key: str) -> Path:
        """An absolute path as it stands, another one below the root."""
        p = Path(self.value(key))
        return p if p.is_absolute() else (self.root / p).resolve()


def overlay(*layers: Mapping) -> dict:
    """Values of the first layers replaced by those of the later ones, mappings merged key by key: defaults, experiment, command line."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = overlay(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def parse_assignments(arguments: list[str]) -> dict:
    """['a.b=1', 'c=x'] as nested values; JSON where it parses, else text."""
    out: dict = {}
    for argument in arguments:
        name, _, raw = argument.partition("=")
        try:
            value = json.loads(raw)
        except json.JSONDecodeError:
            value = raw
        for part in reversed(name.split(".")):
            value = {part: value}
        out = overlay(out, value)
    return out


class Registry(dict):
    """Functions and classes by name, for configurations that name them."""

    def register(self, f: Callable) -> Callable:
        self[f.__name__] = f
        return f

    def find(self, name: str) -> Callable:
        if name not in self:
            raise KeyError(f"no {name}; there are {', '.join(sorted(self))}")
        return self[name]


def _yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def sampling_spec(path: str) -> dict:
    """A sampling specification; the shares of its sections must add up to 1 within 1e-9."""
    spec = _yaml(path)
    total = sum(spec["ratios"].values())
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"ratios add up to {total}")
    return spec


def anchor_spec(spark: SparkSession, path: str) -> DataFrame:
    """key, ipa, category, sigma and rules (muscle, low, high) of an anchor file.

    Raises for a muscle that is not known, a band that is not two numbers in order, or centres of another length
    than the muscles.
    """
    rows = []
    for key, a in _yaml(path)["anchors"].items():
        center = a.get("center")
        if center is not None and len(center) != len(MUSCLES):
            raise ValueError(f"{key}: {len(center)} values for {len(MUSCLES)} muscles")
        for muscle, band in (a.get("rules") or {}).items():
            if muscle not in MUSCLES:
                raise ValueError(f"{key}: no muscle {muscle}")
            if len(band) != 2 or band[0] > band[1]:
                raise ValueError(f"{key}: {muscle} has no band {band}")
        rules = [(m, float(lo), float(hi)) for m, (lo, hi) in (a.get("rules") or {}).items()]
        rows.append((key, a.get("ipa"), a.get("category"), float(a.get("sigma", 0.0)), rules, [float(x) for x in center] if center is not None else None))
    return spark.createDataFrame(rows, "key string, ipa string, category string, sigma double, rules array<struct<muscle: string, low: double, high: double>>, center array<double>")


def first_files(spark: SparkSession, *patterns: str) -> list[str]:
    """The files of the first pattern that any file matches, in name order; raises if none does."""
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        if found:
            return sorted(f.getPath().toString() for f in found)
    raise FileNotFoundError(f"no file for {' or '.join(patterns)}")
