"""Path expressions: whole folder names, one spelling, ancestors. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def plain(path: Column | str) -> Column:
    """One spelling of an absolute path: no empty or ``.`` parts, ``..`` resolved, no slash at the end; null stays null."""
    parts = F.filter(F.split(_column(path), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda seen, p: F.when(p == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within(path: Column | str, root: Column | str) -> Column:
    """Whether ``path`` is ``root`` or lies below it, by whole names; both in one spelling. Below ``/`` lies everything."""
    path, root = _column(path), _column(root)
    return (root == "/") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def below(path: Column | str, root: Column | str) -> Column:
    """Strictly below ``root``."""
    path, root = _column(path), _column(root)
    return ((root == "/") & (path != "/")) | path.startswith(F.concat(root, F.lit("/")))


def within_any(path: Column | str, roots: Sequence[str]) -> Column:
    """Within one of a short list of roots; an empty list holds nothing."""
    found = F.lit(False)
    for root in roots:
        found = found | within(_column(path), plain(F.lit(root)))
    return found


def parent(path: Column | str) -> Column:
    """The folder that holds ``path``; the root's is null."""
    path = _column(path)
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path == "/", None).when(cut == "", F.lit("/")).otherwise(cut)


def name(path: Column | str) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-case extension without the dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1))


def ancestors(path: Column | str) -> Column:
    """All folders above ``path``, the root ``/`` first; whole names."""
    parts = F.filter(F.split(_column(path), "/"), lambda p: p != "")
    count = F.greatest(F.size(parts) - 1, F.lit(0))
    deeper = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.concat(F.array(F.lit("/")), F.coalesce(deeper, F.array().cast("array<string>")))
