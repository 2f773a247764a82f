"""Scanning by declared delimiter pairs: one rule says what opens, what closes, and which match counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

#: The first close behind an open; the close of the outermost open; opens without an open inside.
FIRST, OUTERMOST, INNERMOST = "first", "outermost", "innermost"


@dataclass(frozen=True)
class Rule:
    """A delimiter pair.

    ``open_run`` asks for at least so many repeats of a one-character opener; ``self_closing``
    is a pattern that needs no close; ``line_start`` allows opens only there; ``forbidden`` is
    a pattern that must not stand inside; ``not_behind`` and ``not_before`` are characters that
    must not touch the whole match.
    """

    name: str
    open: str
    close: str
    mode: str = FIRST
    ignore_case: bool = False
    self_closing: str | None = None
    line_start: bool = False
    forbidden: str | None = None
    not_behind: str = ""
    not_before: str = ""


@dataclass(frozen=True)
class Span:
    """A piece of the scanned text: kind is ``text``, ``inner`` or ``self_closing``; inner spans know their delimiters."""

    kind: str
    start: int
    end: int
    inner_start: int = -1
    inner_end: int = -1


@lru_cache(maxsize=64)
def _compiled(rule: Rule) -> tuple[re.Pattern[str], re.Pattern[str] | None]:
    flags = re.M | re.S | (re.I if rule.ignore_case else 0)
    anchor = "^" if rule.line_start else ""
    behind = f"(?<![{re.escape(rule.not_behind)}])" if rule.not_behind else ""
    before = f"(?![{re.escape(rule.not_before)}])" if rule.not_before else ""
    alone = f"(?P<alone>{anchor}{rule.self_closing})|" if rule.self_closing else ""
    return re.compile(f"{alone}(?P<open>{anchor}{behind}{rule.open})|(?P<close>{rule.close}{before})", flags), re.compile(rule.forbidden, flags) if rule.forbidden else None


def scan(text: str, rule: Rule) -> Iterator[Span]:
    """The text as spans in order, without a gap."""
    pattern, forbidden = _compiled(rule)
    found: list[Span] = []
    opens: list[tuple[int, int]] = []
    for m in pattern.finditer(text):
        if m.lastgroup == "alone":
            if not opens or rule.mode == INNERMOST:
                found.append(Span("self_closing", m.start(), m.end()))
        elif m.lastgroup == "open":
            if rule.mode == FIRST and opens:
                continue
            opens.append((m.start(), m.end()))
        elif opens:
            if rule.mode == OUTERMOST and len(opens) > 1:
                opens.pop()
                continue
            s, e = opens.pop()
            if rule.mode == INNERMOST:
                # What stood open around it is not innermost any more.
                opens.clear()
            if forbidden and forbidden.search(text, e, m.start()):
                continue
            found.append(Span("inner", s, m.end(), e, m.start()))
    at = 0
    for f in found:
        if f.start < at:
            continue
        if f.start > at:
            yield Span("text", at, f.start)
        yield f
        at = f.end
    if at < len(text):
        yield Span("text", at, len(text))


def rewrite(text: str, rule: Rule, replace: Callable[[str], str]) -> str:
    """Each match replaced by what ``replace`` gives for its inner text."""
    return "".join(text[s.start : s.end] if s.kind == "text" else replace(text[s.inner_start : s.inner_end] if s.kind == "inner" else text[s.start : s.end]) for s in scan(text, rule))


def fixpoint(text: str, rule: Rule, replace: Callable[[str], str]) -> str:
    """``rewrite`` until nothing changes; what replaces a match must not bring back a match without end."""
    while (new := rewrite(text, rule, replace)) != text:
        text = new
    return text


RULES = {
    r.name: r
    for r in (
        Rule("nowiki", r"<nowiki\s*>", r"</nowiki\s*>", ignore_case=True, self_closing=r"<nowiki\s*/>"),
        Rule("translate", r"<translate(?:\s[^<>]*)?>", r"</translate>"),
        Rule("argument", r"\{\{\{(?!\{)", r"(?<!\})\}\}\}", INNERMOST, not_behind="{", not_before="}"),
        Rule("template", r"\{\{(?!\{)", r"(?<!\})\}\}", INNERMOST, not_behind="{", not_before="}"),
        Rule("template_inner", r"\{\{", r"\}\}", INNERMOST),
        Rule("template_outer", r"\{\{", r"\}\}", OUTERMOST),
        Rule("wikilink", r"\[\[", r"\]\]", INNERMOST, forbidden=r"\n"),
        Rule("converter", r"-\{(?!\{)", r"\}-", INNERMOST),
        Rule("switch", r"__(?=[A-Za-z])", r"(?<=[A-Za-z])__", forbidden=r"[^A-Za-z]"),
        Rule("external_link", r"\[(?=https?://|//)", r"\]", forbidden=r"\n"),
        Rule("comment", r"<!--", r"-->"),
    )
}
