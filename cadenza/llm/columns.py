"""Column names that cannot clash with those of a caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``df`` has no such columns (whatever their case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns of the given names renamed, and the columns that give it back as it was."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    to = dict(zip(clash, unused(df, *clash), strict=True))
    return df.withColumnsRenamed(to), [F.col(f"`{to.get(c, c)}`").alias(c) for c in df.columns]
