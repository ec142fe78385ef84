"""Batches of bounded size inside a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def bounded(texts: Sequence[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``chars`` characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        length = len(text) if isinstance(text, str) else 0
        if i > begin and size + length > chars:
            yield begin, i
            begin, size = i, 0
        size += length
    if begin < len(texts):
        yield begin, len(texts)
