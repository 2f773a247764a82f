"""Splitting oversized texts at natural boundaries.

A text above the limit is cut by a hierarchy of separators: sections, paragraphs, lines,
sentences, words, characters. A part that fits stays whole, a part that does not is cut at
the next finer separator; neighbouring parts are packed greedily, and every piece but the
first begins with the end of the piece before: with the whole overlap at least, and with the
rest of the word that it begins in where the limit leaves room for that. It is less only where
the piece before is shorter, or where blanks between the two pieces take up the room.

Lengths are Unicode code points. Spaces, tabs and line breaks at the ends of a text or piece
never count and are not part of a piece. Defined results: null and blank texts have no
pieces; a text within the limit is one piece; repeated rows of one key count once (the latest
if they differ, then the one with the larger checksum of level and text).
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

EDGE = " \t\r\n"
_BREAK = re.compile(r"\r\n|\n|\r")
_HEADING = re.compile(r"(={2,6})(?!=)(?:.*[^=])?\1[ \t]*\Z|(={2,6})[ \t]*\Z")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?=[ \t\r\n])")
_SPACE = re.compile(r"[ \t\r\n]+")
LEVELS = ("heading", "paragraph", "line", "sentence", "word", "character")


def is_heading(line: str) -> bool:
    """A line that, but for trailing blanks, begins and ends with the same run of 2 to 6 equals signs."""
    s = line.rstrip(" \t\r")
    if not s.startswith("=="):
        return False
    head = len(s) - len(s.lstrip("="))
    tail = len(s) - len(s.rstrip("="))
    return 2 <= head <= 6 and head == tail


def lines(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines of text[start:end], without their breaks."""
    at = start
    for m in _BREAK.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def cuts(text: str, start: int, end: int, level: str) -> list[int]:
    """Places strictly inside text[start:end] where ``level`` cuts; each begins a part."""
    if level == "heading":
        out = [a for a, b in lines(text, start, end) if is_heading(text[a:b])]
    elif level == "paragraph":
        # A blank line parts what stands before and behind it.
        out = [a for a, b in lines(text, start, end) if not text[a:b].strip(" \t\r")]
    elif level == "line":
        out = [m.end() for m in _BREAK.finditer(text, start, end)]
    elif level == "sentence":
        out = [m.end() for m in _SENTENCE.finditer(text, start, end)]
    elif level == "word":
        out = [m.end() for m in _SPACE.finditer(text, start, end)]
    else:
        out = list(range(start + 1, end))
    return [x for x in out if start < x < end]


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in EDGE:
        start += 1
    while end > start and text[end - 1] in EDGE:
        end -= 1
    return start, end


def natural_parts(text: str, start: int, end: int, limit: int, levels: tuple[str, ...] = LEVELS) -> list[tuple[int, int, str]]:
    """Parts within the limit, each with the level at which it was cut; a part that fits is not cut further."""
    a, b = trim(text, start, end)
    if a >= b:
        return []
    if b - a <= limit or not levels:
        return [(a, b, "")]
    if levels[0] == "character":
        return [(x, min(b, x + limit), "character") for x in range(a, b, limit)]
    places = [start, *cuts(text, start, end, levels[0]), end]
    out: list[tuple[int, int, str]] = []
    for x, y in zip(places, places[1:], strict=False):
        for p, q, lv in natural_parts(text, x, y, limit, levels[1:]):
            out.append((p, q, lv or (levels[0] if len(places) > 2 else "")))
    return out


#: Levels that name a section's kind of cut.
NAMED_LEVELS = ("heading", "paragraph", "line", "word")


def coarsest(text: str, limit: int) -> str | None:
    """The first of NAMED_LEVELS that, with the coarser ones, leaves no piece above the limit: the finest one that
    the recursive split needs. None if the text fits."""
    a, b = trim(text, 0, len(text))
    if b - a <= limit:
        return None
    parts = natural_parts(text, a, b, limit, NAMED_LEVELS)
    if any(q - p > limit for p, q, _ in parts):
        return "none"
    return max((lv for _, _, lv in parts if lv), key=NAMED_LEVELS.index)


@dataclass(frozen=True)
class Piece:
    start: int
    body: int
    end: int
    level: str


def pieces(text: str, limit: int, overlap: int) -> list[Piece]:
    """Pieces of one text: text[start:end] with text[start:body] repeated from the piece before."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    a, b = trim(text, 0, len(text))
    if a >= b:
        return []
    if b - a <= limit:
        return [Piece(a, a, b, "")]
    out: list[Piece] = []
    queue = deque(natural_parts(text, a, b, limit - overlap))
    # The piece being packed: where its overlap begins, its body, its end, its level.
    run: tuple[int, int, int, str] | None = None

    def flush() -> None:
        if run is None:
            return
        s, body, end, level = run
        if s < body and text[s - 1] not in EDGE:
            # Back to the beginning of the word, if there is one in the piece before and room for it.
            k = max(text.rfind(c, out[-1].start, s) for c in EDGE) + 1
            s = k if k > 0 and end - k <= limit else s
        # Where blanks take up the room, the overlap is what the limit leaves of it.
        s = min(body, max(s, end - limit))
        while text[s] in EDGE:
            s += 1
        out.append(Piece(s, body, end, level))

    rank = {lv: i for i, lv in enumerate(("", *LEVELS))}
    while queue:
        p, q, level = queue.popleft()
        if run and q - run[0] <= limit:
            run = (run[0], run[1], q, max(run[3], level, key=rank.__getitem__))
            continue
        flush()
        s = max(out[-1].start, out[-1].end - overlap) if out and overlap else p
        room = limit - (p - s)
        if 1 <= room < q - p:
            # Blanks in front leave less room than was thought.
            queue.extendleft(reversed([(x, y, lv or level) for x, y, lv in natural_parts(text, p, q, room)]))
            run = None
            continue
        run = (s, p, q, level)
    flush()
    return out
