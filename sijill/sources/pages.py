"""Scanned pages. Rendering and recognition are plugged in; what they return is a `reading` table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..cluster import ship

READINGS = "path string, page long, text string, x double, y double, w double, h double, confidence double, source string"
#: Limits of a page's rendering and of a recognition pass.
LONGEST_SIDE, LEAST_SCALE, MOST_SCALE = 3600, 1.0, 4.0
PRESETS = ("raw", "enhanced", "binary")


def scale(width: float, height: float, longest: int = LONGEST_SIDE) -> float:
    return max(LEAST_SCALE, min(MOST_SCALE, longest / max(width, height)))


def recognised(files: DataFrame, engine: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    """Readings of files (path, content). engine(path, content) yields (page, text, x, y, w, h, confidence, source) for every page and
    preset; an exception in it ends the job, so no page is silently left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = [(path, *row) for row in engine(path, content)]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in READINGS.split(", ")])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, READINGS)
