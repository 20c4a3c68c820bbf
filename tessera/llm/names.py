"""Column names that a caller's table does not have."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """For each stem a name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
