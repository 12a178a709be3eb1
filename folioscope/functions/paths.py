"""POSIX-like path expressions, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments; a leading ``/`` stays, ``..`` above a relative root stays as ``..``.

    Null stays null, an empty path (or one that resolves to nothing) becomes ``.``.
    """
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((part == "..") & absolute, done)
            .otherwise(F.array_append(done, part))
        )

    simple = ~path.rlike(r"(^|/)\.{0,2}(/|$)")
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    folded = F.when(absolute, F.concat(F.lit("/"), folded)).when(folded == "", ".").otherwise(folded)
    return F.when(simple, path).otherwise(folded)


def directory(path: Column) -> Column:
    """The part before the last ``/``; empty when there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    """The part after the last ``/``."""
    return F.substring_index(path, "/", -1)


def join(base: Column, rest: Column) -> Column:
    """``base/rest`` normalised; an empty base leaves ``rest``."""
    return normalise(F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest)))
