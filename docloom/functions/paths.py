"""Path expressions: parts, normalised form, keys, mirror destination."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """Backslashes as slashes, and no ``file:`` scheme."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file:/*", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def file_directory(path: Column) -> Column:
    """Everything before the last slash, in the original case."""
    return F.regexp_replace(slashed(path), "/[^/]*$", "")


def file_extension(name: Column) -> Column:
    """From the last dot, lower case; a name that only starts with dots has none."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def file_type(name: Column) -> Column:
    return F.ltrim(file_extension(name), F.lit("."))


def norm_path(path: Column) -> Column:
    """Lower case, ``/`` as separator, with ``//``, ``.`` and ``..`` resolved.

    Paths are taken as absolute. A store prefix such as ``s3a://bucket`` stays in front.
    """
    lowered = F.lower(slashed(path))
    store = F.regexp_extract(lowered, r"^([a-z][a-z0-9+.-]+://[^/]*)", 1)
    drive_or_path = F.regexp_replace(lowered, r"^[a-z][a-z0-9+.-]+://[^/]*", "")
    folded = F.aggregate(
        F.split(drive_or_path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    lead = F.when(drive_or_path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(lead, F.array_join(folded, "/"))
    # The fold runs only where there is something to resolve.
    needs_fold = drive_or_path.rlike(r"//|(^|/)\.{1,2}(/|$)|./$")
    return F.concat(store, F.when(needs_fold, resolved).otherwise(drive_or_path))


def document_id(normalised: Column) -> Column:
    return F.sha2(normalised, 256)


def artifact_key(normalised: Column) -> Column:
    return F.md5(normalised)


def normalise_extensions(extensions: Iterable[str]) -> list[str]:
    """Lower case with a leading dot - for a job parameter."""
    lowered = (e.lower() for e in extensions)
    return [e if e.startswith(".") else "." + e for e in lowered]


def normalise_extension(ext: Column) -> Column:
    """The same for a column of extensions."""
    low = F.lower(ext)
    return F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def backup_destination(path: Column, backup_root: str) -> Column:
    """Mirror of ``path`` under ``backup_root``: drive and leading separators removed."""
    tail = F.regexp_replace(path, r"^(?:[A-Za-z]:)?[\\/]*", "")
    return F.concat(F.lit(backup_root.rstrip("/") + "/"), tail)


def relative_to(path: Column, root: Column | str) -> Column:
    """The part of ``path`` below ``root`` (no leading slash). ``path`` must be under it."""
    root_col = F.lit(root) if isinstance(root, str) else root
    root_col = F.rtrim(slashed(root_col), F.lit("/"))
    return F.ltrim(F.substr(slashed(path), F.length(root_col) + 1), F.lit("/"))


def contains_part(lowered: Column, parts: Iterable[str]) -> Column:
    """Does a lower-cased, slashed path contain one of the given parts, in either notation?"""
    out = F.lit(False)
    for part in parts:
        out = out | lowered.contains(part.lower().replace("\\", "/"))
    return out


def ancestors(normalised: Column) -> Column:
    """All folders above a normalised path, nearest last."""
    parts = F.split(normalised, "/")
    upto = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.transform(upto, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def under_any(normalised: Column, roots: Iterable[str]) -> Column:
    """Is the normalised path inside one of the (normalised) roots?"""
    inside = F.lit(False)
    for root in roots:
        inside = inside | normalised.startswith(root.rstrip("/") + "/")
    return inside
