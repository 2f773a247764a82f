"""Nodes, and the projection of a run of texts and nodes onto one string."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

#: A run: texts and nodes in order.
Run = list["str | Node"]

# Marker classes: what a node looks like to later stages. One character stands for one node.
CLASSES = tuple(
    "comment silent extension group call argument subst address bar double_bar table_open table_close row_mark equals "
    "heading tag table list rule switch link redirect quote external magic variant plain".split()
)
BLOCKS = (0xE000, 0xE400, 0xE800, 0xEC00, 0xF000, 0xF400, 0xF0000, 0xFA000, 0x100000, 0x108000)


@dataclass(slots=True)
class Node:
    type: str
    subtype: str
    children: Run = field(default_factory=list)
    name: str | None = None
    sep: str = ""
    data: dict[str, Any] = field(default_factory=dict)
    marker: str = "plain"
    in_ext: bool = False


def block_for(text: str) -> int:
    """A block of private-use characters that the page does not use itself."""
    for base in BLOCKS:
        if not any(chr(base + i) in text for i in range(len(CLASSES))):
            return base
    raise ValueError("the page uses every reserved block")


class Marks:
    """The characters that stand for nodes on one page, and classes of them for patterns."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.char = {c: chr(base + i) for i, c in enumerate(CLASSES)}
        self.any = f"[{chr(base)}-{chr(base + len(CLASSES) - 1)}]"
        self.any_re = re.compile(self.any)

    def of(self, *classes: str) -> str:
        """The inside of a character class for these marker classes."""
        return "".join(self.char[c] for c in classes)


@lru_cache(maxsize=16)
def marks(base: int) -> Marks:
    return Marks(base)


class Projection:
    """A run as one string with one character per node; slices give runs back."""

    __slots__ = ("text", "nodes", "at")

    def __init__(self, run: Run, m: Marks) -> None:
        parts: list[str] = []
        self.nodes: list[Node] = []
        self.at: list[int] = []
        n = 0
        for x in run:
            if isinstance(x, str):
                parts.append(x)
                n += len(x)
            else:
                parts.append(m.char[x.marker])
                self.nodes.append(x)
                self.at.append(n)
                n += 1
        self.text = "".join(parts)

    def cut(self, a: int, b: int) -> Run:
        if a >= b:
            return []
        if not self.at:
            return [self.text[a:b]]
        out: Run = []
        i = bisect_left(self.at, a)
        while i < len(self.at) and self.at[i] < b:
            p = self.at[i]
            if a < p:
                out.append(self.text[a:p])
            out.append(self.nodes[i])
            a = p + 1
            i += 1
        if a < b:
            out.append(self.text[a:b])
        return out


def join(run: Run) -> Run:
    """Neighbouring texts made one, empty ones dropped."""
    out: Run = []
    for x in run:
        if isinstance(x, str):
            if not x:
                continue
            if out and isinstance(out[-1], str):
                out[-1] += x
                continue
        out.append(x)
    return out
