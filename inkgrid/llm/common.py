"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from inkgrid.sources.workspace import forget, keep, workspace

__all__ = ["WORD", "forget", "in_parts", "keep", "workspace"]

#: ASCII white space, as a character class for Java and RE2 patterns alike.
WORD = r"[^\x20\x09-\x0D]+"


def in_parts(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches of at most so many rows each. Spark bounds a batch by its bytes; the parts share its memory, so that what Python makes of whole
    texts is bounded too. Sessions are left as they are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
