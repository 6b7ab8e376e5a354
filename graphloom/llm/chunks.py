"""Cutting texts where no token can cross, and remembering what a chunk gave.

Both tokenisers here never join across the edge before a single space or line
feed, so a text is a row of short chunks that repeat a lot. Work is done once
for each distinct chunk; the memory is bounded and starts afresh when full.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_MARK = "\x1f"
_RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def split_chunks(text: str) -> list[str]:
    """Chunks that concatenate to ``text``; a run of spaces stays whole."""
    if "  " in text or _MARK in text:
        return _RUNS.findall(text)
    return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n").split(_MARK)


class ChunkMemo(dict):
    """Results by chunk, computed on first sight and bounded in number.

    A chunk longer than ``longest`` is computed each time, so that a few huge
    chunks can't fill memory.
    """

    def __init__(self, compute: Callable[[str], object], most: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, chunk: str):
        value = self.compute(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = value
        return value

    def trim(self) -> None:
        """Call between texts."""
        if len(self) > self.most:
            self.clear()
