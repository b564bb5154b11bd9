"""File-name and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def prefix(name: Column) -> Column:
    """The scene's prefix of a stem: a known suffix goes, else the last part after an underscore."""
    known = r"_(A|B|OUT|LABEL|label|mask)$"
    return F.when(name.rlike(known), F.regexp_replace(name, known, "")).when(name.contains("_"), F.regexp_replace(name, r"_[^_]*$", "")).otherwise(name)


def basename(name: Column) -> Column:
    """A prediction's or mask's name without the suffix that tells what it holds."""
    return F.regexp_replace(name, r"_(probmap|probs|prob|cls|pred|mask|gt)$", "")


def tile_offset(name: Column) -> tuple[Column, Column, Column]:
    """prefix, y and x of prefix_y_x."""
    part = lambda k: F.regexp_extract(name, r"^(.+)_(\d+)_(\d+)$", k)
    return part(1), part(2).cast("long"), part(3).cast("long")


def resolve(base: Column, path: Column) -> Column:
    """An absolute path as it is, a relative one under the base; backslashes become slashes."""
    clean = F.translate(path, "\\", "/")
    return F.when(clean.startswith("/"), clean).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), clean))
