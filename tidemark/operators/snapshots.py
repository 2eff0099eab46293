"""Differences between two versions of a table of texts or of its scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hunks import changed_paths, only_changed
from tidemark.session import stored

DRIFT_RATIO = 1.5


def snapshot_diff(
    base: DataFrame, target: DataFrame, path: str, text: str, *, suffix: str = ".py"
) -> DataFrame:
    """Paths with the suffix that were added, removed or modified, with the new text.

    Paths are unique inside a snapshot.  Hashes are joined first; texts of unchanged paths are not moved.
    A NULL text counts as a path that is not there.
    """
    changes = stored(changed_paths(base, target, path, text, suffix), "changed-paths")
    texts = target.select(path, F.col(text).alias("new_content")).filter(F.col("new_content").isNotNull())
    return changes.join(only_changed(texts, changes, path), [path], "left")


def line_diff(
    base: DataFrame, target: DataFrame, path: str, text: str, *, suffix: str = ".py"
) -> DataFrame:
    """Lines added and removed per path: ``path, line, copies`` (negative when removed).

    Both versions are counted per line in one aggregation, so repeated lines
    count as often as they occur and no text is held whole on one side.  Only texts that changed are cut into lines.
    ``line_hunks`` gives their places.
    """
    changes = stored(changed_paths(base, target, path, text, suffix), "changed-paths")

    def lines(df: DataFrame, sign: int) -> DataFrame:
        kept = only_changed(df, changes, path)
        return kept.select(path, F.explode(F.split(text, "\n")).alias("line"), F.lit(sign).alias("_s"))

    both = lines(target, 1).unionByName(lines(base, -1))
    found = both.groupBy(path, "line").agg(F.sum("_s").alias("copies"))
    return found.filter(F.col("copies") != 0)


def drift(
    base: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    distance: str,
    *,
    ratio: float = DRIFT_RATIO,
) -> DataFrame:
    """Compare one distance per key: ``base_distance new_distance drift_detected``."""
    old = base.select(*keys, F.col(distance).alias("base_distance"))
    new = target.select(*keys, F.col(distance).alias("new_distance"))
    rows = new.join(old, [*keys], "inner")
    detected = F.col("new_distance") > F.col("base_distance") * ratio
    return rows.select(*keys, "base_distance", "new_distance", detected.alias("drift_detected"))
