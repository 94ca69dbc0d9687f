"""Names for columns of an operator's own."""

from __future__ import annotations

from collections.abc import Iterable


def own_name(taken: Iterable[str], name: str = "x") -> str:
    """A name that none of ``taken`` has, in any case."""
    have, out = {c.lower() for c in taken}, f"__{name}"
    while out.lower() in have:
        out += "_"
    return out
