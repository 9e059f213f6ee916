"""File names and paths: identity and camera from names, path parts, deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of gallery file names.
PERSON_CAMERA = r"^(-?\d+)_c(\d)s\d"
CAMERA = r"_c(\d)s\d"
#: Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def _group(name: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(name, pattern, group)
    return F.when(found != "", found.cast("int"))


def person_of(name: Column) -> Column:
    """Person number at the start of the name; null for junk (0 and below) and other names."""
    person = _group(name, PERSON_CAMERA, 1)
    return F.when(person > 0, person)


def raw_person_of(name: Column) -> Column:
    return _group(name, PERSON_CAMERA, 1)


def camera_of(name: Column) -> Column:
    """Camera of a whole gallery name, from 0; null where the person is null."""
    return F.when(person_of(name).isNotNull(), _group(name, PERSON_CAMERA, 2) - 1)


def camera_anywhere(name: Column) -> Column:
    """Camera found anywhere in the name, from 0."""
    return _group(name, CAMERA, 1) - 1


def camera_label(name: Column) -> Column:
    """Camera found anywhere in the name, as printed, from 1."""
    return _group(name, CAMERA, 1)


def is_image(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*IMAGE_SUFFIXES) & path.contains(".")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a name that begins with its only dot stays whole."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def relative_to(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def stable_point_id(name: Column) -> Column:
    """The same 64-bit id on every run: the first half of the name's SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, -10).cast("long")


def stable_id(path: Column) -> Column:
    """The same id on every run, so that ingest can be repeated."""
    return F.sha2(path, 256)
