"""Extension points: named, versioned table functions and prediction hooks. Nothing is discovered on its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("drone", "camera", "payload", "mission_type", "engine", "model", "exporter", "report_template", "map_provider")     # fixed values
API_VERSION = "1"


@dataclass(frozen=True)
class Plugin:
    kind: str
    name: str
    apply: Callable[[DataFrame], DataFrame]
    api_version: str = API_VERSION

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown plugin kind {self.kind!r}")
        if not self.name.strip():
            raise ValueError("a plugin needs a name")
        if self.api_version != API_VERSION:
            raise ValueError(f"plugin {self.name!r} targets API {self.api_version}, not {API_VERSION}")


class PluginRegistry:
    """Names are unique per kind, ignoring case."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], Plugin] = {}

    def register(self, plugin: Plugin, replace: bool = False) -> None:
        key = (plugin.kind, plugin.name.casefold())
        if key in self._held and not replace:
            raise ValueError(f"{plugin.kind} plugin {plugin.name!r} is already registered")
        self._held[key] = plugin

    def unregister(self, kind: str, name: str) -> None:
        del self._held[(kind, name.casefold())]

    def get(self, kind: str, name: str) -> Plugin:
        try:
            return self._held[(kind, name.casefold())]
        except KeyError:
            raise KeyError(f"no {kind} plugin named {name!r}") from None

    def names(self, kind: str | None = None) -> list[str]:
        return sorted((p.name for p in self._held.values() if kind in (None, p.kind)), key=str.casefold)

    def run(self, df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.transform(self.get(kind, name).apply)


def predict_tiles(tiles: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], column: str = "pixels") -> DataFrame:
    """Run a predictor over an array column, batch by batch: ``logits array<double>`` per tile. No model ships here."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema if f.name != column) + ", logits array<double>"
    keep = [c for c in tiles.columns if c != column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(logits=[np.asarray(predictor(np.asarray(p, dtype=float)), dtype=float).ravel().tolist() for p in pdf[column]])

    return tiles.mapInPandas(run, schema)


def _metrics(luma: np.ndarray) -> dict:
    img = np.asarray(luma, dtype=np.float64)
    p = np.pad(img, 1, mode="reflect") if min(img.shape) > 1 else np.pad(img, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img
    lo, hi = np.percentile(img, [10, 90])
    rows, cols = (np.array_split(np.arange(n), 8) for n in img.shape)
    small = np.array([[img[np.ix_(r, c)].mean() if len(r) and len(c) else 0.0 for c in cols] for r in rows])
    bits = "".join("1" if v >= small.mean() else "0" for v in small.ravel())
    return {"laplacian_var": float(lap.var()), "dark_ratio": float((img < 5).mean()), "bright_ratio": float((img > 250).mean()), "p10": float(lo), "p90": float(hi), "average_hash": f"{int(bits, 2):016x}"}


def image_pixel_metrics(images: DataFrame, column: str = "luma") -> DataFrame:
    """Sharpness, clipping, percentiles and 8x8 average hash of decoded ``array<array<int>>`` images."""
    @F.pandas_udf("laplacian_var double, dark_ratio double, bright_ratio double, p10 double, p90 double, average_hash string")
    def kernel(luma: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_metrics(np.stack([np.asarray(r) for r in v])) for v in luma])

    return images.withColumn("_m", kernel(F.col(column))).select("*", "_m.*").drop("_m", column)
