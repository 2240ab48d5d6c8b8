"""Names for working columns beside whatever columns a user's table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(rows: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as no column of ``rows`` has, in any case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
