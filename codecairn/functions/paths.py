"""Path scalars. Paths are relative, ``/``-separated; a leading-dot name has no extension."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def raw_extension(path: Column) -> Column:
    """Last suffix with its dot, case kept; ``''`` for ``.env``, ``Makefile`` and ``x.``."""
    base = name(path)
    last = F.substring_index(base, ".", -1)
    has_suffix = (last != "") & (F.length(last) < F.length(base) - 1)
    return F.when(has_suffix, F.concat(F.lit("."), last)).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def stem(path: Column) -> Column:
    base = name(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(raw_extension(path)))


def dirs(path: Column) -> Column:
    """Folder parts, without the file name."""
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def depth(path: Column) -> Column:
    """Number of parts; 1 for a file at the repository root."""
    return F.size(parts(path))


def top_dir(path: Column) -> Column:
    """First folder, null for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))


def is_root_file(path: Column) -> Column:
    return F.instr(path, "/") == 0


def normalise(path: Column) -> Column:
    """Forward slashes, without ``.``, empty and ``..`` parts; null when the path leaves the root."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    kept = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    # The state is the path built so far; null once a '..' has left the root.
    resolved = F.aggregate(
        kept,
        F.lit("").cast("string"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.lit("/"), x))
        .when(acc == "", F.lit(None).cast("string"))
        .otherwise(F.substring(acc, F.lit(1), F.length(acc) - F.length(F.substring_index(acc, "/", -1)) - 1)),
    )
    inside = ~F.startswith(slashed, F.lit("/")) & (resolved != "")
    return F.when(inside, F.substring(resolved, F.lit(2), F.length(resolved)))
