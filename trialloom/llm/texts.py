"""Helpers on single texts."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    """A text cut at blanks or line ends, so that very long texts are looked at piece by piece."""
    size, start = size or PIECE, 0
    while len(text) - start > size:
        end = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        if end <= start:  # one word longer than a piece
            ends = [x for x in (text.find(" ", start + size), text.find("\n", start + size)) if x >= 0]
            end = min(ends, default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def word_pieces(text: str, size: int | None = None) -> Iterator[str]:
    """A text cut only before a blank that follows something else.

    No run of blanks or line ends and no word is cut, so what tokenizers make of a run stays as it is.
    """
    size, start = size or PIECE, 0
    while len(text) - start > size:
        end = start + size
        while end > start and not (text[end] == " " and not text[end - 1].isspace()):
            end = text.rfind(" ", start, end)
        if end <= start:
            end = start + size
            while 0 <= end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
        yield text[start:end]
        start = end
    yield text[start:]
