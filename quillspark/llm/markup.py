"""Markup residue in texts: which notations a text holds, its content region, and clean text.

A lexer cuts a text into words and tags of four notations (html, markdown, wiki, latex). Words
score positive and tags negative; the weights are log odds fitted on labelled pages, and one
linear scan finds the contiguous segment with the largest sum: the content region. With the
signs turned, for one notation at a time, the same scan finds the segment that is most markup;
a text holds a notation if such a segment scores above zero.

Clean text is made from the lexer's spans and the region: code and formulas come through as
they stand, everything in the region is kept without its tags, and of what lies outside those
blocks are kept that are headings, list entries, code, formulas or score above zero themselves.

Defined results: null, empty and blank texts have no kinds and a null region; texts are read
whole, whatever their length; the region is null if no segment scores above zero, and clean
text then keeps every block.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5

KINDS = ("html", "markdown", "wiki", "latex")

_NAMED = {k[:-1] for k in html5 if k.endswith(";")}
# Attributes that stand without a value, and behaviour switches.
_BARE_ATTRS = "allowfullscreen async autofocus checked compact controls default defer disabled hidden ismap loop multiple muted noshade novalidate nowrap open readonly required reversed selected"
_SWITCHES = (
    "NOTOC FORCETOC TOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY "
    "NOCONTENTCONVERT NOCC NOTITLECONVERT NOTC START END INDEX NOINDEX STATICREDIRECT DISAMBIG NOGLOBAL"
)
_BARE = "|".join(_BARE_ATTRS.split())
_ATTR = rf"""(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+)|\s+(?:{_BARE})(?=[\s/>]))"""
_URL = r"(?:https?://|ftp://|ircs?://|news:|mailto:|//)"

# Name, kind, pattern; the first that matches at a place wins. HTML code and preformatted
# regions are not swallowed whole: other notations inside them count too.
_RULES: tuple[tuple[str, str, str], ...] = (
    ("comment", "html", r"<!--"),
    ("tag", "html", rf"</?[A-Za-z][\w:-]*{_ATTR}*\s*/?>"),
    ("charref", "html", r"&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("fence", "markdown", r"^[ ]{0,3}(?:```+|~~~+)[ \t]*[\w+#.-]*[ \t\r]*$"),
    ("delimiter_row", "markdown", r"^[ \t]*(?:\|[ \t]*)?:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|[ \t]*(?::?-+:?[ \t]*)?\r?$"),
    ("number_heading", "markdown", r"^[ ]{0,3}\#{1,6}[ \t]+(?=\S)"),
    ("environment", "latex", r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
    ("display", "latex", r"\$\$(?=[^$\n])[^$]+?\$\$|\\[\[(]"),
    ("dollars", "latex", r"(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)*?(?<=\S)\$(?![\w$])"),
    ("command", "latex", r"(?<![\w:\\/])\\[A-Za-z]{2,}\*?(?![\w\\/:.]|-\w)|(?<=[A-Za-z.,;!?)])\\(?:footnote|cite[a-z]*|ref|label|textbf|textit|emph|index|url)\b"),
    ("image", "markdown", r"""!\[[^\[\]\n]*\]\([^()\s]+(?:\s+(?:"[^"\n]*"|'[^'\n]*'))?\)"""),
    ("link", "markdown", r"""(?<!\])\[[^\[\]\n]+\]\([^()\s]+(?:\s+(?:"[^"\n]*"|'[^'\n]*'))?\)"""),
    ("code", "markdown", r"(?<!`)``(?!`).+?(?<!`)``(?!`)|(?<!`)`(?!`)[^`\n]+`(?!`)"),
    ("argument", "wiki", r"\{\{\{[^{}\n|]+(?:\||\}\}\})"),
    ("template", "wiki", r"\{\{(?=\s*[\w#:!=/])[^{}]*?(?=\}\}|\{\{|\||\Z)"),
    ("wikitable", "wiki", r"^[ \t:]*\{\||^[ \t]*\|\}(?!\})|^[ \t]*\|-[-]*[ \t]*(?:\w+\s*=[^\n]*)?\r?$"),
    ("bracket_link", "wiki", r"\[\[(?![\s\d.,;+\-*]*\])(?=[^\[\]\n{}|<>]*[^\W\d_])[^\[\]\n{}<>]+?(?:\]\]|\|)"),
    ("labelled_link", "wiki", rf"\[{_URL}[^\s\[\]<>]+[ \t]+[^\]\n]+\]"),
    ("equals_heading", "wiki", r"^(?P<eq>={1,6})(?!=)[^\n]*(?P=eq)[ \t\r]*$"),
    ("quotes", "wiki", r"(?<!')'{2,5}(?=[^'\s=,;)\]])(?=[^\n]*?'')|(?<=[^'\s=(\[,])'{2,5}(?!')"),
    ("switch", "wiki", rf"__(?:{'|'.join(_SWITCHES.split())})__"),
    ("signature", "wiki", r"(?<![~\w/])~{3,5}(?![~\w/])"),
    ("strong", "markdown", r"(?<![*\w\\])\*{2,3}(?=[^\s*])"),
    ("emphasis", "markdown", r"(?<![*\w\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*\\])\*(?![*\w])"),
    ("word", "", r"[^\W_]+(?:['’-][^\W_]+)*"),
)
_KIND = {name: kind for name, kind, _ in _RULES}
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, _, p in _RULES), re.M | re.S)
#: Every tag holds one of these; a text without any is words only.
_SIGN = re.compile(r"[<&`$\\\[{*|]|''|~~~|__|^ {0,3}#|^=", re.M)
#: Where a strong run closes, or its line ends without.
_STRONG_END = re.compile(r"\n|(?<=[^\s*\\])\*{2,3}(?![*\w])")
#: Length of the opening sign of what holds other text; the lexer goes on behind it.
_OPEN = {"comment": 4, "image": 2, "template": 2, "argument": 3, "bracket_link": 2, "emphasis": 1, "labelled_link": 1, "link": 1}
#: Of these only the tags inside are read: their words are no content.
_NO_CONTENT = ("comment", "tag", "display", "dollars", "code", "image", "template", "argument", "bracket_link")
_WORD = re.compile(next(p for n, _, p in _RULES if n == "word"))
_LETTER = re.compile(r"[^\W_]")
_ARITH = re.compile(r"[\s\d.,]*")


_MATHY = re.compile(r"[\\^_={}+<>|/*-]|^[A-Za-z]['′]?$|^[A-Za-z]\([^)]*\)$")


def _genuine(name: str, s: str, text: str, at: int) -> bool:
    """What a pattern alone can't tell: plain text that only looks like a tag."""
    if name == "charref":
        return s[1] == "#" or s[1:-1] in _NAMED
    if name == "number_heading" and s.strip() == "#":
        # Lines that follow each other with one number sign are a numbered list.
        line_end = text.find("\n", at)
        before = text.rfind("\n", 0, max(0, at - 1)) + 1
        return not (line_end >= 0 and re.match(r"#[ \t]", text[line_end + 1 : line_end + 3]) or (before < at and re.match(r"#[ \t]", text[before : before + 2])))
    if name == "display" and s[0] == "\\":
        # An opened formula counts if one is closed further on.
        return text.find("\\]" if s[1] == "[" else "\\)", at + 2) > at + 2
    if name == "equals_heading":
        return bool(s.strip("= \t\r"))
    if name == "dollars":
        inner = s[1:-1]
        if re.match(r"\d[\d.,]*\s+[A-Za-z]{2,}", inner):
            return False
        return bool(_MATHY.search(inner))
    if name == "tag":
        # Type parameters, as in list<int>: a bare unknown name right behind a word.
        inner = re.match(r"<([A-Za-z]\w*)>$", s)
        if inner and at and text[at - 1].isalnum() and inner[1].lower() in ("int", "str", "string", "float", "double", "bool", "boolean", "long", "bigint", "char", "byte", "t", "k", "v", "struct", "object", "integer"):
            return False
    if name == "quotes" and len(s) == 2:
        before = text[at - 1] if at else " "
        if before.isdigit() and text.rfind("''", text.rfind("\n", 0, at) + 1, at) < 0:
            return False
    if name == "emphasis":
        inner = s.strip("*")
        # Products and globs: operands around lone asterisks.
        if not any(c.isalnum() for c in inner) or re.fullmatch(r"[\d.,\s]+", inner) or (at and text[at - 1] in "./"):
            return False
    return True


def _stands_alone(name: str, s: str, text: str, start: int, end: int, low: int, limit: int, inside: str) -> bool:
    """Whether a tag within the formula or code text[low:limit] is one, and not a sign of the formula or code itself."""
    before, after = text[start - 1] if start > low else " ", text[end] if end < limit else " "
    if name == "quotes":
        # Primes and doubled quote signs follow what they belong to.
        return not (before.isalnum() or before in ")]}'\"") and text.find("''", end, limit) >= 0
    if name == "bracket_link":
        return not (before.isalnum() or before in "_)]") and not text[start + 2].isspace()
    if name == "tag" and (bare := re.fullmatch(r"<([A-Za-z][\w:-]*)>", s)):
        return text.find(f"</{bare[1]}", end, limit) >= 0 or (len(bare[1]) > 1 and not before.isalnum())
    if name == "signature" and inside == "code":
        return before.isspace() and after.isspace()
    if inside == "code":
        if name == "command":
            return before.isspace() or before in "{}$(" or after == "{"
        return name != "display" or s[0] == "$" or text.find("\\]" if s[1] == "[" else "\\)", end, limit) >= 0
    if name in ("strong", "emphasis"):
        return before.isspace() and after.isspace()
    if name in ("template", "argument"):
        return before.isspace()
    if name == "signature":
        # Tildes are blanks in a formula.
        return False
    if name in ("link", "image"):
        return any(c in s[s.index("](") :] for c in "./#")
    return name != "equals_heading" or s.startswith("==")


def lex(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of each word and tag of a text in order; tags may hold others, which follow them."""
    at, quiet, commented = 0, 0, 0
    # What is being read: where it begins and ends, where to go on behind it, and whether it is a formula or code.
    open_ = [(0, len(text), len(text), "")]
    # The next place where a strong run closes or its line ends: for starts from ... to ...
    closes = (-1, 0, -1, 0)
    while open_:
        low, limit, after, inside = open_[-1]
        m = _LEX.search(text, at, limit) if at < limit else None
        if not m:
            open_.pop()
            at = after
            continue
        name = m.lastgroup
        start, end = m.span()
        if name == "word":
            if start >= quiet:
                yield name, start, end
            at = end
            continue
        at = start + 1
        if name == "strong":
            inner = end
            if closes[0] != limit or not closes[1] <= end <= closes[2]:
                c = _STRONG_END.search(text, end, limit)
                closes = (limit, end, c.start() if c else limit, c.end() if c and c[0] != "\n" else 0)
            end = closes[3]
            if not end or not _LETTER.search(text, inner, end):
                continue
        elif not _genuine(name, m[0], text, start):
            continue
        if inside and not _stands_alone(name, m[0], text, start, end, low, limit, inside):
            continue
        if name == "comment":
            if start < commented:
                at = end
                continue
            # Where none is closed, all further ones lie inside it.
            close = text.find("-->", end)
            commented = close + 3 if close >= 0 else len(text)
            end = close + 3 if close >= 0 else end
        yield name, start, end
        if name in _NO_CONTENT:
            quiet = max(quiet, end)
        k = 0
        if name == "dollars" or (name == "display" and m[0][0] == "$"):
            k = 1 if name == "dollars" else 2
            open_.append((start + k, end - k, end, "formula"))
        elif name == "code":
            k = 2 if m[0].startswith("``") else 1
            open_.append((start + k, end - k, end, "code"))
        elif name == "tag" and "=" in m[0]:
            k = 1
            open_.append((start + k, end - k, end, "code"))
        elif name == "strong":
            k = 2 if m[0][:2] == "**" else 1
        elif name == "equals_heading":
            k = len(m["eq"])
        else:
            k = _OPEN.get(name, 0)
        at = start + k if k else max(end, start + 1)


# Pages whose content lies between the two marks, written for this purpose.
LABELLED_PAGES = (
    '<html><head><title>Rain</title></head><body><div class="nav"><a href="/">Home</a> <a href="/x">More</a></div>⟦The rain fell for nine days, and the lower fields stood under water until the dikes were opened.⟧<hr/><p>&copy;</p></body></html>',
    "{{Notice|x}}\n__NOTOC__\n⟦A kiln is an oven for drying or firing. The oldest known kilns were simple pits. ''Later'' ones had two chambers, and the [[flue]] led the heat upward.⟧\n{{stub}}\n[[Category:Ovens]]\n[[Category:Clay]]",
    "\\documentclass{article}\n\\usepackage{amsmath}\n\\begin{document}\n⟦We show that every bounded sequence has a convergent part, and that the limit $x$ does not depend on the choice of the part.⟧\n\\bibliography{a}\n\\end{document}",
    "[![badge](a.png)](b) [![badge](c.png)](d)\n\n⟦# Install\n\nRun the script and wait until the **server** answers. The log says where the data went.⟧\n\n[a](b) | [c](d) | [e](f)",
    '<table><tr><td><img src="a.png"/></td><td><br/></td></tr></table>⟦Bees leave the hive when the morning is warm enough, and they come back before the shadows grow long.⟧<ul><li><a href="b">b</a></li><li><a href="c">c</a></li></ul>',
    "{| class=\"nav\"\n|-\n| [[a]] || [[b]]\n|}\n⟦The harbour was dredged twice in that century, which let larger ships reach the northern quay at low tide.⟧\n<!-- end -->\n[[Category:Harbours]]",
)


@lru_cache(maxsize=8)
def weights(pages: tuple[str, ...] = LABELLED_PAGES) -> dict[str, float]:
    """Log odds of each token class to lie in the content of a labelled page, with one token of each kind added."""
    inside, outside = Counter(), Counter()
    for page in pages:
        a, b = page.index("⟦"), page.index("⟧")
        for name, start, _ in lex(page):
            (inside if a < start < b else outside)[_KIND[name] or "word"] += 1
    total_in, total_out = sum(inside.values()), sum(outside.values())
    names = ("word", *KINDS)
    return {k: math.log((inside[k] + 1) / (total_in + len(names))) - math.log((outside[k] + 1) / (total_out + len(names))) for k in names}


def best_region(scored: list[tuple[float, int, int]]) -> tuple[int, int, float] | None:
    """(start, end, sum) of the contiguous run of (score, start, end) with the largest sum; the first of equals."""
    best, run, run_start = None, 0.0, 0
    for score, start, end in scored:
        if run <= 0:
            run, run_start = 0.0, start
        run += score
        if run > 0 and (best is None or run > best[2]):
            best = (run_start, end, run)
    return best


@dataclass(frozen=True)
class Analysis:
    """What the scan gives for one text."""

    #: Of each notation the segment that is most markup: (start, end, sum).
    kinds: dict[str, tuple[int, int, float]]
    region: tuple[int, int, float] | None
    tags: int
    tags_in_region: int


_NOTHING = Analysis({}, None, 0, 0)


def _markup_runs(tags: list[tuple[str, int, int, int]], w: dict[str, float]) -> dict[str, tuple[int, int, float]]:
    """Per notation the best run with the signs turned: tags of the notation add, words between them take off.

    tags: (kind, start, end, words before it); one step per tag, as words between two tags come as one sum.
    """
    best: dict[str, tuple[int, int, float]] = {}
    run: dict[str, tuple[int, float, int]] = {}
    for kind, start, end, words in tags:
        first, total, at = run.get(kind, (start, 0.0, words))
        total -= w["word"] * (words - at)
        if total <= 0:
            first, total = start, 0.0
        total -= w[kind]
        run[kind] = (first, total, words)
        if total > 0 and (kind not in best or total > best[kind][2]):
            best[kind] = (first, end, total)
    return best


def analyse(text: str | None, pages: tuple[str, ...] = LABELLED_PAGES) -> Analysis:
    """Notations and content region of a text by the scan over its scored words and tags."""
    if not text or not text.strip():
        return _NOTHING
    w = weights(pages)
    tags, scored, words = [], [], 0
    if not _SIGN.search(text):
        # The region goes from the first word to the last.
        spans = [m.span() for m in _WORD.finditer(text)]
        return Analysis({}, (spans[0][0], spans[-1][1], w["word"] * len(spans)) if spans else None, 0, 0)
    for name, start, end in lex(text):
        kind = _KIND[name]
        if kind:
            tags.append((kind, start, end, words))
        else:
            words += 1
        scored.append((w[kind or "word"], start, end))
    region = best_region(scored)
    inside = sum(region[0] <= t[1] < region[1] for t in tags) if region else 0
    return Analysis(_markup_runs(tags, w), region, len(tags), inside)


# ---- clean text ---------------------------------------------------------------------------

# Elements and environments whose contents are code or formulas, elements that begin a block.
_CODE_TAGS = frozenset("pre code syntaxhighlight source tt samp kbd math chem nowiki".split())
_FORMULA_ENVIRONMENTS = frozenset("equation align gather multline eqnarray displaymath math alignat split cases array verbatim lstlisting minted".split())
_BLOCK_TAGS = frozenset("p div ul ol li table tr hr br blockquote h1 h2 h3 h4 h5 h6 section article nav header footer aside main body head html dl dt dd".split())
_TAG_NAME = re.compile(r"</?([A-Za-z][\w:-]*)")
_LIST_LINE = re.compile(r"[ \t]*(?:[*#:;]+|[-+•]|\d{1,4}[.)])[ \t]*\S|[ \t]*\\item\b")
# Tags within running text, which say nothing against the block they stand in.
_STYLE = frozenset("comment quotes strong emphasis charref command code dollars display delimiter_row".split())
_HEADINGS = ("number_heading", "equals_heading")


def _code_text(name: str, opening: str, inner: str) -> str:
    if name in ("math", "chem"):
        return f"${inner}$"
    if name == "nowiki":
        return inner
    if name in ("pre", "syntaxhighlight", "source") or "\n" in inner:
        lang = re.search(r"""\blang\s*=\s*["']?([\w+#.-]+)""", opening)
        body = inner.strip("\n")
        return f"\n```{lang[1] if lang else ''}\n{body}\n```\n"
    return f"`{inner}`"


def _kept_spans(t: str, toks: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, text to stand there) of code and formulas, which cleaning must not touch."""
    out: list[tuple[int, int, str]] = []
    done = 0
    low = t.lower()
    fences = [(a, b) for n, a, b in toks if n == "fence"]
    # Where a search found nothing, a later one for the same closing sign won't either.
    absent: set[str] = set()

    def close(sign: str, at: int, where: str = t) -> int:
        if sign in absent:
            return -1
        k = where.find(sign, at)
        if k < 0:
            absent.add(sign)
        return k

    for name, a, b in toks:
        if a < done:
            continue
        end, shown = 0, None
        if name == "fence":
            mark = t[a:b].lstrip()[0]
            # The next fence of the same sign closes; none: the code runs to the end.
            k = bisect_left(fences, (a + 1, 0))
            while k < len(fences) and t[fences[k][0] : fences[k][1]].lstrip()[0] != mark:
                k += 1
            end = fences[k][1] if k < len(fences) else len(t)
        elif name in ("code", "dollars") or (name == "display" and t[a] == "$"):
            end = b
        elif name == "display":
            k = close("\\]" if t[a + 1] == "[" else "\\)", b)
            end = k + 2 if k >= 0 else 0
        elif name == "environment" and t.startswith("\\begin", a):
            env = t[a + 7 : b - 1]
            if env.rstrip("*") in _FORMULA_ENVIRONMENTS:
                sign = "\\end{" + env + "}"
                k = close(sign, b)
                end = k + len(sign) if k >= 0 else 0
        elif name == "tag" and t[a + 1] != "/" and t[b - 2] != "/":
            tag = _TAG_NAME.match(t, a)[1].lower()
            if tag in _CODE_TAGS and (k := close(f"</{tag}", b, low)) >= 0 and (e := t.find(">", k)) >= 0:
                end, shown = e + 1, _code_text(tag, t[a:b], t[b:k])
        if end > a:
            out.append((a, end, t[a:end] if shown is None else shown))
            done = end
    return out


_PAIRS = re.compile(r"\{\||\|\}(?!\})|\{\{|\}\}")


def _whole_spans(t: str, toks: list[tuple[str, int, int]], kept: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans that no block boundary cuts: code, formulas, comments, tables, templates and tags over several lines."""
    out = [(a, b) for a, b, _ in kept] + [(a, b) for n, a, b in toks if n != "word" and t.find("\n", a, b) >= 0]
    opened: list[tuple[str, int]] = []
    for m in _PAIRS.finditer(t):
        if m[0] in ("{|", "{{"):
            opened.append((m[0], m.start()))
        elif opened and opened[-1][0] == ("{|" if m[0] == "|}" else "{{"):
            at = opened.pop()[1]
            if not opened:
                out.append((at, m.end()))
    return sorted(out)


def _blocks(t: str, toks: list[tuple[str, int, int]], kept: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The text cut at line ends and at block elements, but never within a construct that belongs together."""
    cuts = {m.end() for m in re.finditer(r"\n", t)}
    # A block goes from an opening tag to the closing one, or to the next opening one.
    cuts |= {b if t[a + 1] == "/" or t[b - 2] == "/" else a for n, a, b in toks if n == "tag" and _TAG_NAME.match(t, a)[1].lower() in _BLOCK_TAGS}
    whole = _whole_spans(t, toks, kept)
    places, k, reach = [0], 0, 0
    for c in sorted(cuts):
        while k < len(whole) and whole[k][0] < c:
            reach = max(reach, whole[k][1])
            k += 1
        if places[-1] < c < len(t) and c >= reach:
            places.append(c)
    return list(zip(places, [*places[1:], len(t)], strict=True))


def _content(t: str, toks: list[tuple[str, int, int]], kept: list[tuple[int, int, str]], region: tuple[int, int, float] | None, w: dict[str, float]) -> list[tuple[int, int]]:
    """The blocks that clean text is made of: those of the region, and outside it structure and what scores above zero."""
    if region is None:
        return [(0, len(t))]
    blocks = _blocks(t, toks, kept)
    out: list[tuple[int, int]] = []
    # What shares a line with the region goes only if it is a bar of linked elements.
    line = (t.rfind("\n", 0, region[0]) + 1, (t.find("\n", region[1]) + 1 or len(t) + 1) - 1)
    k = i = 0
    for a, b in blocks:
        score, structure, entry, linked, anchored = 0.0, False, False, False, False
        while k < len(toks) and toks[k][1] < b:
            name, x, _ = toks[k]
            score += 0 if name in _STYLE else w[_KIND[name] or "word"]
            structure |= name in _HEADINGS or (name == "command" and t.startswith(("\\section", "\\subsection", "\\subsubsection", "\\chapter"), x)) or (name == "tag" and t[x + 1 : x + 2] in "hH" and t[x + 2 : x + 3] in "123456")
            entry |= name == "tag" and t[x + 1 : x + 3].lower() == "li"
            anchored |= name == "tag" and t[x + 1 : x + 3].lower() in ("a ", "a>")
            linked |= name in ("link", "image", "bracket_link", "labelled_link") or anchored
            k += 1
        # An entry that is a link is navigation.
        structure |= entry and not linked
        while i < len(kept) and kept[i][0] < b:
            structure |= kept[i][0] >= a
            i += 1
        beside = a < line[1] and b > line[0] and not anchored
        if beside or (a < region[1] and b > region[0]) or score >= 0 or structure or _LIST_LINE.match(t, a, b):
            out.append((a, b))
    return out


_TABLE_INNER = re.compile(r"\{\|((?:(?!\{\||\|\}).)*)\|\}", re.S)
_ATTRS = re.compile(r"[^|\[{]*=[^|\[{]*\|(?!\|)")


def _table_text(m: re.Match[str]) -> str:
    """A wiki table as rows of cells between bars, the header with its line below it."""
    rows: list[tuple[bool, list[str]]] = [(False, [])]
    caption = ""
    for line in m[1].split("\n")[1:]:
        s = line.strip()
        if s.startswith("|-"):
            rows.append((False, []))
        elif s.startswith("|+"):
            caption = s[2:].strip()
        elif s[:1] in ("|", "!"):
            head = s[0] == "!"
            cells = [_ATTRS.sub("", c, count=1).strip() for c in re.split(r"\|\||!!" if head else r"\|\|", s[1:])]
            rows[-1] = (rows[-1][0] or head, rows[-1][1] + cells)
        elif s and rows[-1][1]:
            rows[-1][1][-1] += " " + s
    out = [caption] if caption else []
    for head, cells in rows:
        if cells:
            out.append("| " + " | ".join(cells) + " |")
            if head and len(out) == 1 + bool(caption):
                out.append("|" + " --- |" * len(cells))
    return "\n" + "\n".join(out) + "\n"


_CELL = re.compile(r"<(t[dh])\b[^<>]*>", re.I)
_CELL_GAP = re.compile(r"</t[dh]\s*>\s*(?=<t[dh]\b)", re.I)


# Signs that come off the text between code and formulas, in this order; each pattern is linear.
_CLEAN = (
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""),
    (re.compile(r"<(h[1-6])\b[^<>]*>((?:(?!<h[1-6]\b).)*?)</\1\s*>", re.S | re.I), lambda m: "\n" + "#" * int(m[1][1]) + " " + m[2].strip() + "\n"),
    (re.compile(r"<li\b[^<>]*>\s*", re.I), "\n- "),
    (_CELL_GAP, " | "),
    (_CELL, ""),
    (re.compile(r"</?(?:p|div|ul|ol|table|tr|br|hr|blockquote|h[1-6]|section|dl|dt|dd)\b[^<>]*>", re.I), "\n"),
    (re.compile(rf"</?[A-Za-z][\w:-]*{_ATTR}*\s*/?>"), ""),
    (re.compile(rf"__(?:{'|'.join(_SWITCHES.split())})__"), ""),
    (re.compile(r"^(={1,6})(?!=)([^\n]*)\1[ \t]*$", re.M), lambda m: "#" * len(m[1]) + " " + m[2].strip() if m[2].strip("= \t") else m[0]),
    (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}"), lambda m: "\n" + "#" * (m[0].count("sub") + 1) + " " + m[1] + "\n"),
    (re.compile(r"\\item\b\s*"), "\n- "),
    (re.compile(r"\\(?:cite|ref|label|index)[a-z]*\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|text|url)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|center|document|quote|table|tabular|figure)\*?\}(?:\{[^{}]*\})?"), "\n"),
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"(?<!\])\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\[(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo)\s*:[^\[\]\n|]*(?:\|[^\[\]\n|]*)*?(?:\|([^\[\]\n|]*))?\]\]", re.I), lambda m: m[1] or ""),
    (re.compile(r"\[\[:?(?![\s\d.,;]*\])([^\[\]\n{}|]+)(?:\|([^\[\]\n]*))?\]\]"), lambda m: m[2] if m[2] is not None and m[2].strip() else m[1]),
    (re.compile(rf"\[{_URL}[^\s\[\]<>]+[ \t]+([^\]\n]+)\]"), r"\1"),
    (re.compile(r"(?<!')'{2,5}(?=[^'\s=,;)])([^'\n]*(?:'[^'\n]+)*)'{2,5}(?!')"), r"\1"),
    (re.compile(r"(?<![~\w/])~{3,5}(?![~\w/])"), ""),
)
_ARG = re.compile(r"\{\{\{[^{}|]*(?:\|([^{}]*))?\}\}\}")
_TEMPLATE = re.compile(r"(?P<line>^[ \t]*)?\{\{(?=\s*[\w#:!=/])([^{}]*)\}\}(?P<end>[ \t]*$)?", re.M)
_NOTE = re.compile(r"<ref\b([^<>]*?)(?:/>|>((?:(?!<ref\b).)*?)</ref\s*>)|\\footnote\{([^{}]*)\}", re.S | re.I)
_BLANKS = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
#: A parameter of a template that stands alone is text from so many words on.
_TEXT_WORDS = 5


def _template_text(m: re.Match[str]) -> str:
    """What a template shows: within a line its last plain parameter, else its parameters that are running text."""
    parts = [p.strip() for p in m[2].split("|")[1:]]
    if m["line"] is not None and m["end"] is not None:
        texts = [p.partition("=")[2].strip() if re.match(r"[\w -]*=", p) else p for p in parts]
        return "\n".join(x for x in texts if len(x.split()) >= _TEXT_WORDS)
    plain = [p for p in parts if p and not re.match(r"[\w -]+=", p)]
    return (m["line"] or "") + (plain[-1] if plain and _LETTER.search(plain[-1]) else "") + (m["end"] or "")


def clean(text: str | None, pages: tuple[str, ...] = LABELLED_PAGES) -> str | None:
    """The content of a text without markup.

    Headings come out with number signs, list entries with ``-``, tables as rows between bars,
    code and formulas as they stand, footnotes as ``[^1]`` with their texts at the end.
    """
    if text is None:
        return None
    t = text.replace("\r\n", "\n")
    toks = list(lex(t))
    w = weights(pages)
    region = best_region([(w[_KIND[n] or "word"], a, b) for n, a, b in toks])
    kept = _kept_spans(t, toks)
    mark = next((chr(c) for c in range(0xE000, 0xF900) if chr(c) not in t), "\x00")
    # Edits in order: code and formulas become a number between marks, runs of asterisks lose them.
    edits = [(a, b, f"{mark}{i}{mark}") for i, (a, b, _) in enumerate(kept)]
    starts = [a for a, _, _ in kept]
    for name, a, b in toks:
        k = bisect_left(starts, a + 1) - 1
        if name in ("strong", "emphasis") and not (k >= 0 and a < kept[k][1]):
            n = len(t[a:b]) - len(t[a:b].lstrip("*"))
            e = len(t[a:b]) - len(t[a:b].rstrip("*"))
            edits += [(a, a + n, ""), (b - e, b, "")]
    edits.sort()
    out: list[str] = []
    j = 0
    for a, b in _content(t, toks, kept, region, w):
        while j < len(edits) and edits[j][0] < a:
            j += 1
        while j < len(edits) and edits[j][0] < b:
            x, y, to = edits[j]
            j += 1
            if x < a:
                continue
            out += [t[a:x], to]
            a = y
        out.append(t[a:b])
    return _plain("".join(out), [x for _, _, x in kept], mark)


def _plain(t: str, kept: list[str], mark: str) -> str:
    notes: list[str] = []
    named: dict[str, int] = {}

    def note(m: re.Match[str]) -> str:
        name = re.search(r"""\bname\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/]+))""", m[1] or "")
        key = next(x for x in name.groups() if x is not None).strip() if name else None
        body = m[2] if m[2] is not None else m[3]
        if key is None or key not in named:
            notes.append((body or "").strip())
            n = len(notes)
            if key is not None:
                named[key] = n
        else:
            n = named[key]
            notes[n - 1] = notes[n - 1] or (body or "").strip()
        return f"[^{n}]"

    t = _NOTE.sub(note, t)
    if notes:
        t = t.rstrip() + "\n\n" + "\n".join(f"[^{i + 1}]: {' '.join(x.split())}" for i, x in enumerate(notes))
    before = None
    while "{{" in t and before != t:
        before, t = t, _TEMPLATE.sub(_template_text, _ARG.sub(lambda m: m[1] or "", t))
    before = None
    while "{|" in t and before != t:
        before, t = t, _TABLE_INNER.sub(_table_text, t)
    for pattern, to in _CLEAN:
        t = pattern.sub(to, t)
    t = _BLANKS.sub("\n\n", html.unescape(t)).strip()
    return re.sub(f"{mark}(\\d+){mark}", lambda m: kept[int(m[1])], t).strip() if kept else t
