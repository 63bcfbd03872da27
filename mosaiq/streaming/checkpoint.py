"""High-water marks per site, as a small JSON object in a file that is replaced as a whole."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from mosaiq.runtime import read_text, replace_text


def load(spark: SparkSession, path: str) -> dict[str, int]:
    """site -> last id; a missing or malformed file counts as empty, an entry that isn't a whole number as absent."""
    try:
        found = json.loads(read_text(spark, path) or "{}")
        return {str(k): v for k, v in found.items() if isinstance(v, int) and not isinstance(v, bool) and v >= 0}
    except (ValueError, AttributeError):
        return {}


def save(spark: SparkSession, path: str, marks: dict[str, int]) -> None:
    replace_text(spark, path, json.dumps(marks, indent=2, sort_keys=True))


def get(marks: dict[str, int], site: str) -> int:
    return marks.get(site, 0)
