"""Index names of paths, path filters and URL functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _dull(part: Column) -> Column:
    """A component that says nothing: hexadecimal only, or without a vowel."""
    return part.rlike("^[0-9a-fA-F]*\\z") | ~part.rlike(P.VOWEL)


def clean_name(name: Column) -> Column:
    base = F.regexp_replace(name, "\\.journal~?\\z", "")
    parts = F.filter(F.regexp_extract_all(base, F.lit("[^\\-_.]*[\\-_.]|[^\\-_.]+"), F.lit(0)), lambda p: ~_dull(p))
    kept = F.regexp_replace(F.array_join(parts, ""), "[^A-Za-z.\\-]", "")
    kept = F.regexp_replace(F.regexp_replace(kept, "(\\.gz)+\\z", ""), "(\\.txt)+\\z", "")
    kept = F.regexp_replace(kept, "^[._\\-]+|[._\\-]+\\z", "")
    return F.when(base.startswith("instance-00"), "instance").when(F.contains(base, F.lit("@")), F.split(base, "@", -1)[0]).when(base.startswith("sosreport-"), F.regexp_extract(base, "^sosreport-[^-]*", 0)).otherwise(kept)


def index_name(path: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(path, P.UID_IN_PATH, "UID"), "/", -1), lambda p: p != "")
    dirs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~(_dull(p) | p.isin(*P.IRRELEVANT_DIRS)))
    name = clean_name(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("NA")))
    return F.when(F.size(dirs) > 0, F.concat(clean_name(F.try_element_at(dirs, F.lit(-1))), F.lit("/"), name)).otherwise(name)


def included(path: Column, includes: list[str] | None = None, excludes: tuple[str, ...] = P.EXCLUDED_PATHS) -> Column:
    """Whether a path is read: it matches an include, if any, and no exclude; .gz does not count."""
    bare = F.regexp_replace(path, "(\\.gz)+\\z", "")
    ok = ~bare.rlike("|".join(excludes)) if excludes else F.lit(True)
    return ok & bare.rlike("|".join(includes)) if includes else ok


def file_format(path: Column) -> Column:
    return F.when(path.rlike("\\.journal~?\\z"), "journal").when(path.rlike("\\.json(\\.gz)?\\z"), "json").when(path.rlike("\\.xml(\\.gz)?\\z"), "xml").otherwise("text")
