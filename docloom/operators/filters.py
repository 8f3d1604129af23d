"""Row predicates of the catalog: which files, folders, extensions and runs count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths


def is_document(name: Column, extensions: Sequence[str] = C.DOCUMENT_EXTENSIONS) -> Column:
    """Extension on the allowlist (which also drops names without one)."""
    return paths.file_extension(name).isin(*extensions)


def is_temporary(name: Column) -> Column:
    """Names that start with ``~`` or ``.``."""
    return name.startswith("~") | name.startswith(".")


def in_excluded_folder(
    path: Column, root: Column | str, names: Sequence[str] = C.EXCLUDED_FOLDER_NAMES
) -> Column:
    """Does any folder between the root and the file have an excluded or a dot name?

    The root itself is never tested.
    """
    below = F.lower(paths.file_directory(F.concat(F.lit("/"), paths.relative_to(path, root))))
    return F.exists(
        F.split(below, "/"), lambda part: part.isin(*[n.lower() for n in names]) | part.startswith(".")
    )


def has_excluded_part(path: Column, parts: Sequence[str] = C.EXCLUDED_PATH_PARTS) -> Column:
    """Does the folder path contain one of the excluded parts?

    Both sides use ``/``, so patterns written with either separator match as intended.
    """
    return paths.contains_part(F.lower(paths.file_directory(path)), parts)


def accepted(
    path: Column,
    root: Column | str,
    extensions: Sequence[str] = C.DOCUMENT_EXTENSIONS,
    names: Sequence[str] = C.EXCLUDED_FOLDER_NAMES,
    parts: Sequence[str] = C.EXCLUDED_PATH_PARTS,
) -> Column:
    """All file and folder rules together."""
    name = paths.file_name(path)
    return (
        is_document(name, extensions)
        & ~is_temporary(name)
        & ~in_excluded_folder(path, root, names)
        & ~has_excluded_part(path, parts)
    )


def is_backed_up_type(
    extension: Column, excluded: Sequence[str] = C.BACKUP_EXCLUDED_EXTENSIONS
) -> Column:
    return ~extension.isin(*paths.normalise_extensions(excluded)) if excluded else F.lit(True)


def is_fresh(
    running: Column, at: Column, now: Column, stale_after: int = C.STALE_AFTER_SEC
) -> Column:
    """A running flag counts only while its record is younger than ``stale_after`` seconds."""
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_after))
    return running & ((now - at) < limit)
