"""Column expressions over dotted hierarchical names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_of(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def scope_of(path: Column) -> Column:
    """Everything before the leaf; empty for a bare name."""
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


def to_absolute(name: Column, core: str, tile: str, tile_scopes: Sequence[str]) -> Column:
    """Short name to full path; scopes beside the core resolve under ``tile``."""
    head = F.substring_index(name, ".", 1)
    return (
        F.when(name.startswith("top."), name)
        .when(name == "", F.lit(core))
        .when(head.isin(list(tile_scopes)), F.concat(F.lit(tile + "."), name))
        .otherwise(F.concat(F.lit(core + "."), name))
    )


def to_relative(path: Column, core: str, tile: str) -> Column:
    """Inverse of :func:`to_absolute`; the core root is tried first."""
    return (
        F.when(path.startswith(core + "."), F.substring(path, len(core) + 2, 1 << 30))
        .when(path.startswith(tile + "."), F.substring(path, len(tile) + 2, 1 << 30))
        .otherwise(path)
    )


def file_of(ref: Column) -> Column:
    """``a/b/c.scala:12:3`` to ``c.scala:12:3``; empty when there is no reference."""
    return F.coalesce(F.substring_index(ref, "/", -1), F.lit(""))


def under_scope(path: Column, prefix: str) -> Column:
    """``p`` takes the whole subtree, ``p.*`` only that scope's own signals."""
    if prefix.endswith(".*"):
        root = prefix[:-1]
        return path.startswith(root) & ~F.substring(path, len(root) + 1, 1 << 30).contains(".")
    root = prefix if prefix.endswith(".") else prefix + "."
    return path.startswith(root)
