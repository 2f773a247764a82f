"""The staged parse of one page.

A page is a run of texts and nodes. Each stage takes a run and gives a run in which what it
recognises has become nodes; later stages see a node as one character of its marker class.
Nodes keep their own contents as runs, and which stages go over which contents is said once,
in ``CONTEXTS``. Unmatched markup stays literal text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

from quillspark.kernel.config import SiteConfig, default
from quillspark.kernel.model import Marks, Node, Projection, Run, block_for, join, marks
from quillspark.kernel.title import WIDE_SPACE, decode_entities, normalize, parse_title

MAX_STAGE = 10

_TIDY = re.compile(r"[\x00\x7f]|\r(?=\n|\Z)")

# Contents by role: the stages that run over them.
CONTEXTS: dict[str, tuple[int, ...]] = {
    "parameter-value": (2, 3, 4, 5, 6, 7, 8, 9, 10),
    "arg-default": (2, 3, 4, 5, 6, 7, 8, 9, 10),
    "parameter-key": (2, 5, 6, 7, 8),
    "td-inner": (4, 5, 6, 7, 8, 9, 10),
    "table-inter": (4, 5, 6, 7, 8, 9, 10),
    "ext-inner": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
    "heading-title": (5, 6, 7, 8, 10),
    "link-text": (6, 10),
    "image-parameter": (5, 6, 7, 8, 10),
    "converter-rule-to": (5, 6, 7, 8),
    "converter-rule-from": (),
    "param-line": (0, 1, 2, 5, 6, 7, 8),
}
#: Attributes whose values are markup: (tag or None for any, attribute) to the stages that run over the value.
_RICH = (1, 5, 6, 7, 8, 10)
ATTR_CONTEXTS: dict[tuple[str | None, str], tuple[int, ...]] = {
    (None, "title"): (10,), ("img", "alt"): (10,), ("gallery", "caption"): _RICH, ("ref", "details"): _RICH,
    ("mapframe", "text"): _RICH, ("maplink", "text"): _RICH, ("choose", "before"): _RICH, ("choose", "after"): _RICH,
}
# Extension tags whose content is markup again, and those whose content is lines.
PARSED_EXT = frozenset("ref poem indicator langconvert references section gallery imagemap inputbox dynamicpagelist categorytree".split())
#: First lines of these start in the middle of a line, where lists and tables are literal.
MIDLINE = frozenset(("td-inner", "ext-inner"))
#: Marker classes that no stage counts as content.
QUIET = ("comment", "silent", "switch")
NO_HEADING = frozenset(("parameter-key", "poem", "references", "attr-value"))
#: Words that stand for a sign, and the marker class of that sign.
_ESCAPES = {"!": "bar", "=": "equals", "(!": "table_open", "!)": "table_close", "!!": "double_bar", "!-": "row_mark"}
_URL_WORDS = ("server", "filepath", "fullurl", "fullurle", "canonicalurl", "canonicalurle")


def tidy(text: str) -> str:
    """Text without NUL, DEL and the carriage returns of line ends."""
    return _TIDY.sub("", text)


def plain(run: Run) -> str:
    """The texts of a run, without its nodes."""
    return "".join(x for x in run if isinstance(x, str))


def visible(run: Run) -> str:
    """The texts of a run and of its nodes, without comments and switches; for names."""
    from quillspark.kernel.serialize import to_text

    return "".join(x if isinstance(x, str) else "" if x.marker in QUIET else to_text(x) for x in run)


class Grammar:
    """The compiled patterns of one configuration and one block of marks."""

    def __init__(self, config: SiteConfig, base: int) -> None:
        self.config, self.m = config, marks(base)
        m: Marks = self.m
        quiet = m.of(*QUIET)
        names = "|".join(sorted(map(re.escape, config.ext), key=len, reverse=True)) or r"(?!)"
        self.ext_open = re.compile(rf"<({names})((?:\s[^<>]*?)?)(/>|>)", re.I)
        self.redirect = re.compile(rf"\A(\s*)({'|'.join(map(re.escape, sorted(config.redirection, key=len, reverse=True)))})([ \t]*:?[ \t]*)\[\[([^\n|\]]+)(?:\|([^\n\]]*))?\]\]([ \t]*)", re.I)
        self.html = re.compile(rf"<(/?)([A-Za-z][^\s/><{m.any[1:-1]}]*)([^<>]*?)(/?)>")
        bar, gap = rf"(?:\||{m.char['bar']})", rf"[\s{quiet}]"
        self.bar = re.compile(bar)
        self.table_open = re.compile(rf"([ \t{quiet}]*)(:*)([ \t{quiet}]*)(\{{\||\{{{m.char['bar']}|{m.char['table_open']})")
        self.table_close = re.compile(rf"[ \t{quiet}]*(?:\|\}}|{m.char['bar']}\}}|{m.char['table_close']})")
        self.table_row = re.compile(rf"[ \t{quiet}]*(?:{bar}-|{m.char['row_mark']})-*")
        self.table_cell = re.compile(rf"[ \t{quiet}]*(?:{bar}(?P<cap>\+)|(?P<head>!)|{bar})")
        self.cell_split = re.compile(rf"(?:{bar}){{2}}|{m.char['double_bar']}")
        self.head_split = re.compile(rf"(?:{bar}){{2}}|{m.char['double_bar']}|!!")
        # Comments count as gaps around the sign, and a word may stand for it.
        between = rf"[\s{m.of('comment', 'silent')}]*"
        key = m.of("comment", "silent", "equals")
        pattern = Page.ATTR_PATTERN.replace(r"\s*=\s*", rf"{between}(?:=|{m.char['equals']}){between}")
        pattern = pattern.replace(r"""(?P<key>[^\s=<>"'/][^\s=<>"']*)""", rf"""(?P<key>[^\s=<>"'/{key}][^\s=<>"'{key}]*)""")
        self.table_attr = re.compile(pattern, re.S)
        self.hr = re.compile(rf"([{quiet}]*)(-{{4,}})", 0)
        self.heading = re.compile(rf"(=+)(.+)(?<!=)(=+)((?:[ \t]|[{m.of('comment', 'silent')}])*)\Z|(={{3,}})((?:[ \t]|[{m.of('comment', 'silent')}])*)\Z")
        words = "|".join(sorted(map(re.escape, {*config.switches_ci, *(x.lower() for x in config.switches_cs)}), key=len, reverse=True)) or r"(?!)"
        self.switch = re.compile(rf"(__|＿＿)({words})(__|＿＿)", re.I)
        self.link_target = re.compile(rf"\[\[([^\n\[\]{{}}|{m.char['bar']}]+)(?:({bar})|(?=\]\]))")
        stop = rf"\s\[\]<>\"\x00-\x20\x7f{m.of('extension', 'redirect', 'tag', 'table', 'list', 'heading', 'magic', 'link', 'quote', 'rule', 'switch', 'variant', 'external', 'plain')}"
        self.protocol = re.compile(config.protocol_re, re.I)
        # A host may be an address in brackets; a word that gives an address may stand for all of it.
        host = r"(?:\[[0-9A-Fa-f:.]+\])?"
        self.ext_link = re.compile(rf"\[((?:{config.protocol_re}){host}[^{stop}]+|(?:{config.protocol_re})\[[0-9A-Fa-f:.]+\]|{m.char['address']}[^{stop}]*|(?:{config.protocol_re})(?=[\s\]]))([ \t 　]*)([^\]\n]*)\]", re.I)
        free = "|".join(re.escape(p) for p in config.protocols if p != "//") or r"(?!)"
        gap1 = r"(?:[\t \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]|&nbsp;|&#0*160;|&#[xX]0*[aA]0;)"
        dash = rf"(?:-|{gap1})?"
        self.free = re.compile(
            rf"(?<![\w])(?P<url>(?i:{free})(?:{host}[^{stop}{m.of('comment', 'silent')}]+|\[[0-9A-Fa-f:.]+\]))|(?<![\w])(?P<rfc>(?:RFC|PMID){gap1}+[0-9]+)(?!\w)|(?<![\w])(?P<isbn>ISBN{gap1}+(?:97[89]{dash})?(?:[0-9]{dash}){{9}}[0-9Xx])(?!\w)"
        )
        self.list = re.compile(rf"([{quiet}]*)([*#:;]+)")
        self.gap = re.compile(gap)
        self.image = [(re.compile(re.escape(k).replace(r"\$1", "(.*)") + r"\Z", re.S), k, v) for k, v in sorted(config.img.items(), key=lambda x: (-len(x[0]), x[0])) if "$1" in k]
        self.image_words = {k: v for k, v in config.img.items() if "$1" not in k}


#: Compiled grammars by version and block of marks; a worker meets few.
_GRAMMARS: dict[tuple[str, int], Grammar] = {}


def grammar(config: SiteConfig, base: int) -> Grammar:
    key = (config.version, base)
    if key not in _GRAMMARS:
        _GRAMMARS[key] = Grammar(config, base)
    return _GRAMMARS[key]


class Page:
    """One parse: the grammar, the flags and the counters."""

    def __init__(self, config: SiteConfig, base: int, include: bool, title: str | None) -> None:
        self.g = grammar(config, base)
        self.config, self.m, self.include, self.title = config, self.g.m, include, title

    def project(self, run: Run) -> Projection:
        return Projection(run, self.m)

    # ---- stage 0: redirect, comments, extension and include tags -------------------------

    def redirect(self, run: Run) -> Run:
        p = self.project(run)
        m = self.g.redirect.match(p.text)
        if not m or not parse_title(m[4], self.config, 0, self.title).valid:
            return run
        target = Node("REDIRECT_TARGET", "redirect-target", [Node("ATOM", "link-target", p.cut(*m.span(4)))], sep="|", name=parse_title(m[4], self.config, 0, self.title).title)
        if m[5] is not None:
            target.children.append(Node("PLAIN", "link-text", p.cut(*m.span(5))))
        syntax = Node("REDIRECT_SYNTAX", "redirect-syntax", p.cut(m.start(2), m.end(3)))
        node = Node("REDIRECT", "redirect", [syntax, target], name=target.name, data={"pre": m[1], "post": m[6], "link": m[4], "display": m[5]}, marker="redirect")
        return [node, *p.cut(m.end(), len(p.text))]

    def comments(self, run: Run, in_ext: bool = False) -> Run:
        if not any(isinstance(x, str) and "<" in x for x in run):
            return run
        p = self.project(run)
        t = p.text
        if self.include and (found := self._onlyinclude(p)) is not None:
            return found
        out: Run = []
        done = at = 0
        while (at := t.find("<", at)) >= 0:
            node, end = self._comment_at(p, at, in_ext)
            if node is None:
                at += 1
                continue
            out += [*p.cut(done, at), node]
            done = at = end
        return [*out, *p.cut(done, len(t))] if out else run

    _ONLY = re.compile(r"<onlyinclude>(.*?)</onlyinclude>", re.S)
    _COMMENT = re.compile(r"<!--(.*?)(-->|\Z)", re.S)

    def _onlyinclude(self, p: Projection) -> Run | None:
        out: Run = []
        done = 0
        for m in self._ONLY.finditer(p.text):
            if m.start() > done:
                out.append(Node("NOINCLUDE", "noinclude", p.cut(done, m.start()), marker="silent"))
            inner = self.pipeline(p.cut(*m.span(1)), range(0, 2))
            out.append(Node("ONLYINCLUDE", "onlyinclude", inner, data={"open": "<onlyinclude>", "tag_closing": "</onlyinclude>"}, marker="group"))
            done = m.end()
        if done and done < len(p.text):
            out.append(Node("NOINCLUDE", "noinclude", p.cut(done, len(p.text)), marker="silent"))
        return out if done else None

    _TRANSLATE = re.compile(r"<translate(?:\s[^<>]*)?>")
    _TRANSLATE_END = re.compile(r"</translate>|(?i:<nowiki\s*>.*?</nowiki\s*>)", re.S)

    def _translate_end(self, t: str, at: int) -> int:
        """Where the closing tag stands; one inside nowiki closes nothing."""
        while m := self._TRANSLATE_END.search(t, at):
            if m[0] == "</translate>":
                return m.start()
            at = m.end()
        return -1

    def _comment_at(self, p: Projection, at: int, in_ext: bool) -> tuple[Node | None, int]:
        t = p.text
        if t.startswith("<!--", at):
            m = self._COMMENT.match(t, at)
            return Node("COMMENT", "comment", p.cut(*m.span(1)), data={"closed": bool(m[2])}, marker="comment"), m.end()
        single = r"includeonly" if self.include else r"(?:noinclude|onlyinclude)"
        m = re.compile(rf"</?{single}(?:\s[^<>]*)?/?>", re.I).match(t, at)
        if m:
            return Node("NOINCLUDE", "noinclude", p.cut(*m.span()), marker="silent"), m.end()
        pair = "noinclude" if self.include else "includeonly"
        m = re.compile(rf"<({pair})(\s[^<>]*?)?(?:/>|>(.*?)(</{pair}\s*>|\Z))", re.I | re.S).match(t, at)
        if m:
            body = p.cut(*m.span(3)) if m[3] is not None else []
            head = t[m.start() : m.start(3)] if m[3] is not None else m[0]
            return Node("INCLUDE", "include", body, data={"open": head, "tag": m[1], "attr": m[2] or "", "inner": plain(body), "tag_closing": m[4] or ""}, marker="silent"), m.end()
        if "translate" in self.config.ext and (m := self._TRANSLATE.match(t, at)) and (close := self._translate_end(t, m.end())) >= 0:
            return Node("TRANSLATE", "translate", self.comments(p.cut(m.end(), close), in_ext), data={"open": m[0], "tag": "translate", "tag_closing": "</translate>"}, marker="group"), close + len("</translate>")
        m = self.g.ext_open.match(t, at)
        if not m:
            return None, at
        name, attrs, tail = m[1], p.cut(*m.span(2)), m[3]
        low = name.lower()
        if low == "translate":
            return None, at
        if m[2].endswith("/") and tail == ">":
            tail, attrs = "/>", p.cut(m.start(2), m.end(2) - 1)
        data = {"ext_name": name, "self_closing": tail == "/>", "ext_attr": plain(attrs), "ext_inner": None, "ext_closing": None}
        kids: Run = [Node("EXT_ATTRS", "ext-attrs", self.attributes(attrs, "ext", low), name=low)]
        end = m.end()
        if tail == ">":
            close = re.compile(rf"</({re.escape(name)})\s*>", re.I).search(t, end)
            if not close:
                return None, at
            body = p.cut(end, close.start())
            data |= {"ext_inner": plain(body), "ext_closing": close[0]}
            kids.append(Node("EXT_INNER", "ext-inner", self.ext_inner(low, body, kids[0]), name=low))
            end = close.end()
        return Node("EXT", "ext", kids, name=low, data=data, marker="extension"), end

    # ---- contents of extension tags ------------------------------------------------------

    def ext_inner(self, name: str, body: Run, attrs: Node) -> Run:
        if name == "pre":
            keep = any(isinstance(a, Node) and a.name == "format" and visible(a.children).lower().find("wikitext") >= 0 for a in attrs.children)
            return body if keep else self._split_nodes(body, re.compile(r"</?nowiki>", re.I), "NOINCLUDE", "noinclude", "silent")
        if name == "references":
            inner = self.pipeline(self.comments(body, True), (1,))
            return [x if isinstance(x, Node) else Node("NOINCLUDE", "noinclude", [x], marker="silent") for x in inner if x != ""]
        if name in ("inputbox", "dynamicpagelist"):
            p = self.project(body)
            lines: Run = []
            for i, (a, b) in enumerate(self._lines(p.text) if body else []):
                lines += ["\n"] if i else []
                lines += [Node("PLAIN", "param-line", p.cut(a, b))] if a < b else []
            return lines
        if name in ("gallery", "imagemap"):
            return self._image_lines(name, body)
        if name == "categorytree":
            return [Node("ATOM", "link-target", body)] if body else []
        return body

    def _split_nodes(self, run: Run, pattern: re.Pattern[str], type_: str, subtype: str, marker: str) -> Run:
        p, out, done = self.project(run), [], 0
        for m in pattern.finditer(p.text):
            out += [*p.cut(done, m.start()), Node(type_, subtype, p.cut(*m.span()), marker=marker)]
            done = m.end()
        return [*out, *p.cut(done, len(p.text))]

    @staticmethod
    def _lines(t: str) -> list[tuple[int, int]]:
        out, at = [], 0
        while (e := t.find("\n", at)) >= 0:
            out.append((at, e))
            at = e + 1
        return [*out, (at, len(t))]

    _AREA = re.compile(r"(\s*(?:rect|circle|poly|default)\b[^\[]*)(\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]|\[(\S+?)(\s+[^\[\]]*)?\])(\s*)\Z", re.I)

    def _image_lines(self, name: str, body: Run) -> Run:
        p, out, seen = self.project(body), [], False
        for i, (a, b) in enumerate(self._lines(p.text)):
            line = p.text[a:b]
            if i:
                out.append("\n")
            file, bar, _ = line.partition("|")
            if name == "imagemap" and seen:
                m = self._AREA.match(line)
                if m:
                    link = p.cut(a + m.start(2), a + m.end(2))
                    kids = [p.text[a : a + m.end(1)], *self.pipeline(link, (5, 7)), m[7]]
                    out.append(Node("PLAIN", "imagemap-link", [k for k in kids if k != ""]))
                else:
                    out.append(Node("NOINCLUDE", "noinclude", p.cut(a, b), marker="silent")) if line else None
                continue
            title = parse_title(file.strip(), self.config, 6, self.title)
            if not line.strip() or not title.valid or title.ns != 6:
                if line:
                    out.append(Node("NOINCLUDE", "noinclude", p.cut(a, b), marker="silent"))
                continue
            seen = True
            kids: Run = [Node("ATOM", "link-target", p.cut(a, a + len(file)))]
            if bar:
                at = a + len(file) + 1
                # What stands in the line is read before its bars are, so that markup with bars stays whole.
                kids += self.image_parameters(self.pipeline(p.cut(at, b), (0, 1, 2, 5), in_ext=True), title.title, name == "gallery")
            out.append(Node("FILE", "gallery-image" if name == "gallery" else "imagemap-image", kids, name=title.title, sep="|", marker="link"))
        return out

    # ---- attributes ----------------------------------------------------------------------

    ATTR_PATTERN = r"""(?P<key>[^\s=<>"'/][^\s=<>"']*)(?:(?P<eq>\s*=\s*)(?:(?P<q>["'])(?P<quoted>.*?)(?P=q)|(?P<bare>[^\s"'<>=`][^\s<>]*)|(?P<none>(?=\s|\Z))))?"""
    _ATTR = re.compile(ATTR_PATTERN, re.S)
    _KEY = re.compile(r"[\w:][\w:.\-]*\Z")

    def _equal(self, run: Run) -> str:
        """The text of an equals sign with what stands around it."""
        from quillspark.kernel.serialize import to_text

        return "".join(x if isinstance(x, str) else to_text(x) for x in run)

    def attributes(self, run: Run, kind: str, name: str | None) -> Run:
        """The attribute nodes of a run; what is none, white space too, is kept in dirty nodes."""
        p = self.project(run)
        t, out, done = p.text, [], 0
        dirty_type = "ATOM" if kind == "table" else "EXT_ATTR_DIRTY"

        def dirty(a: int, b: int) -> None:
            if a < b:
                out.append(Node(dirty_type, f"{kind}-attr-dirty", p.cut(a, b)))

        for m in (self.g.table_attr if kind == "table" else self._ATTR).finditer(t):
            key = self.m.any_re.sub("", m["key"])
            if not (self._KEY.match(key) if key else kind != "ext") or m.start() < done:
                continue
            dirty(done, m.start())
            data: dict = {"equal": m["eq"] and self._equal(p.cut(*m.span("eq"))), "quote_open": m["q"], "quote_close": m["q"]}
            kids: Run = [Node("ATTR_KEY", "attr-key", p.cut(*m.span("key")))]
            value = Node("ATTR_VALUE", "attr-value", [])
            if m["q"]:
                value.children = p.cut(*m.span("quoted")) or [""]
            elif m["bare"] is not None:
                value.children = p.cut(*m.span("bare"))
            kids.append(value)
            out.append(Node("EXT_ATTR", f"{kind}-attr", kids, name=visible(p.cut(*m.span("key"))).strip().lower(), data=data))
            done = m.end()
        dirty(done, len(t))
        return out

    # ---- stage 1: arguments, templates, magic words --------------------------------------

    _BRACE = re.compile(r"\[\[|\]\]|-\{(?!\{)|\}-|\{\{+|\}\}+|\||=|\n")

    def braces(self, run: Run) -> Run:
        if not any(isinstance(x, str) and "{{" in x for x in run):
            return run
        p = self.project(run)
        t = p.text
        root: list[Run] = [[]]
        # A frame: opener, count of braces, parts, place of the first equals sign in each part.
        stack: list[tuple[str, int, list[Run], list[int | None]]] = []

        def part() -> Run:
            return stack[-1][2][-1] if stack else root[0]

        def flatten() -> None:
            opener, n, parts, _ = stack.pop()
            lit: Run = [opener * n if opener == "{" else opener]
            for i, x in enumerate(parts):
                lit += ["|", *x] if i else x
            part().extend(lit)

        done = 0
        for m in self._BRACE.finditer(t):
            part().extend(p.cut(done, m.start()))
            done = m.end()
            s = m[0]
            if s[0] == "{":
                stack.append(("{", len(s), [[]], [None]))
            elif s == "[[" or s == "-{":
                stack.append((s, 1, [[]], [None]))
            elif s in ("]]", "}-"):
                if stack and stack[-1][0] == ("[[" if s == "]]" else "-{"):
                    flatten()
                elif s == "}-" and stack and stack[-1][0] == "{":
                    pass
                part().append(s)
            elif s == "|":
                if stack and stack[-1][0] == "{":
                    stack[-1][2].append([])
                    stack[-1][3].append(None)
                else:
                    part().append(s)
            elif s == "=":
                if stack and stack[-1][0] == "{" and len(stack[-1][2]) > 1 and stack[-1][3][-1] is None:
                    stack[-1][3][-1] = len(part())
                part().append(s)
            elif s == "\n":
                part().append(s)
            else:
                n = len(s)
                while n >= 2:
                    # A link or variant left open inside a template is literal text.
                    if not stack or stack[-1][0] != "{":
                        k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "{"), None)
                        if k is None:
                            break
                        while len(stack) - 1 > k:
                            flatten()
                    _, have, parts, eqs = stack.pop()
                    k = min(n, have, 3)
                    node = self.argument(parts) if k == 3 else self.template(parts, eqs)
                    if node is None and k == 3 and (inner := self.template(parts, eqs)) is not None:
                        k, node = 2, inner
                    if node is None:
                        lit: Run = ["{" * k]
                        for i, x in enumerate(parts):
                            lit += ["|", *x] if i else x
                        body: Run = [*lit, "}" * k]
                    else:
                        body = [node]
                    n -= k
                    if have - k >= 2:
                        stack.append(("{", have - k, [body], [None]))
                    else:
                        if have - k:
                            part().append("{")
                        part().extend(body)
                if n:
                    part().append("}" * n)
        part().extend(p.cut(done, len(t)))
        while stack:
            flatten()
        return join(root[0])

    def argument(self, parts: list[Run]) -> Node | None:
        kids: Run = [Node("ATOM", "arg-name", join(parts[0]))]
        if len(parts) > 1:
            kids.append(Node("PLAIN", "arg-default", join(parts[1])))
        kids += [Node("HIDDEN", "hidden", join(x)) for x in parts[2:]]
        marker = "subst" if len(parts) > 1 and plain(parts[1]).strip().rstrip(":").lower() in self.config.modifiers_subst else "argument"
        return Node("ARG", "arg", kids, name=visible(parts[0]).strip(), sep="|", marker=marker)

    def template(self, parts: list[Run], eqs: list[int | None]) -> Node | None:
        c = self.config
        head = join(parts[0])
        raw = visible(head)
        if not raw.strip():
            return None
        modifier, rest = "", head
        lead = head[0] if isinstance(head[0], str) else ""
        m = re.match(r"(\s*)([^:{}|\n]+:)", lead)
        if m and m[2][:-1].strip().lower() in (*c.modifiers_raw, *c.modifiers_subst):
            modifier, rest = m[0], join([lead[m.end() :], *head[1:]])
            if not visible(rest).strip():
                return None
        node = self.magic_word(rest, parts[1:], eqs[1:])
        if node is None:
            p = self.project(rest)
            if any(x in p.text for x in (self.m.char["tag"], self.m.char["extension"], self.m.char["link"])) and "{" not in visible(rest):
                return None
            name = visible([x for x in rest if isinstance(x, str) or x.marker not in QUIET]).strip(WIDE_SPACE)
            holds = any(isinstance(x, Node) and x.marker not in QUIET for x in rest)
            title = parse_title(name.split("#")[0] if holds else name, c, 10, self.title)
            if not title.valid and not holds:
                return None
            if "\n" in plain(rest).strip() or (name.startswith("#") and not holds):
                return None
            full = title.title if title.valid else name
            node = Node("TRANSCLUDE", "template", [Node("SYNTAX", "template-name", rest)], name=full, sep="|", marker="call")
            node.children += self.parameters(parts[1:], eqs[1:], first=1)
        node.data["modifier"] = modifier or None
        return node

    def magic_word(self, rest: Run, more: list[Run], eqs: list[int | None]) -> Node | None:
        c = self.config
        lead = rest[0] if rest and isinstance(rest[0], str) else ""
        word, colon, tail = lead.partition(":")
        key = word.strip()
        if not colon and len(rest) > 1:
            return None
        low = key.lower()
        if not colon and not more and low in c.variables:
            marker = _ESCAPES.get(key, "address" if low in _URL_WORDS else "call")
            return Node("TRANSCLUDE", "magic-word", [Node("SYNTAX", "magic-word-name", rest)], name=low, sep="|", marker=marker)
        canonical = c.functions_cs.get(key) or c.functions_ci.get(low) or (low if colon and low in c.variables else None)
        if canonical is None or not colon:
            return None
        node = Node("TRANSCLUDE", "magic-word", [Node("SYNTAX", "magic-word-name", [word])], name=canonical, sep="|", data={"colon": True}, marker="address" if low in _URL_WORDS else "call")
        first: Run = join([tail, *rest[1:]])
        name = canonical.lstrip("#")
        if name == "invoke":
            node.children.append(Node("ATOM", "invoke-module", first))
            if more:
                node.children.append(Node("ATOM", "invoke-function", join(more[0])))
            node.data |= {"module": visible(first).strip(), "function": visible(more[0]).strip() if more else None}
            node.children += self.parameters(more[1:], eqs[1:], first=1)
            return node
        node.children += self.parameters([first], [None], first=1)
        named = name == "switch"
        for i, (x, e) in enumerate(zip(more, eqs, strict=True)):
            node.children += self.parameters([x], [e if named or (name == "tag" and i >= 1) else None], first=i + 2)
        return node

    def parameters(self, parts: list[Run], eqs: list[int | None], first: int) -> Run:
        out: Run = []
        anon = first
        for x, e in zip(parts, eqs, strict=True):
            if e is None:
                key, value, name = Node("PLAIN", "parameter-key"), join(x), str(anon)
                anon += 1
            else:
                key, value = Node("PLAIN", "parameter-key", join(x[:e])), join(x[e + 1 :])
                name = visible(x[:e]).strip(" \t\n\0\x0b")
            out.append(Node("PARAMETER", "parameter", [key, Node("PLAIN", "parameter-value", value)], name=name, data={"anon": e is None}))
        return out

    # ---- stage 2: HTML tags --------------------------------------------------------------

    def html(self, run: Run) -> Run:
        if not any(isinstance(x, str) and "<" in x for x in run):
            return run
        p = self.project(run)
        t = p.text
        out: Run = []
        done = 0
        for m in self.g.html.finditer(t):
            name = m[2].lower()
            if m.start() < done or name not in self.config.html_names:
                continue
            a, b = m.span(3)
            attrs = self.attributes(p.cut(a, b), "html", name)
            if name in ("meta", "link"):
                keys = {x.name for x in attrs if isinstance(x, Node)}
                if "itemprop" not in keys or not keys & {"content", "href"}:
                    continue
            node = Node("HTML", "html", [Node("ATTRIBUTES", "html-attrs", attrs, name=name)], name=name, data={"closing": bool(m[1]), "self_closing": bool(m[4]), "orig_tag": m[2]}, marker="tag")
            out += [*p.cut(done, m.start()), node]
            done = m.end()
        return [*out, *p.cut(done, len(t))] if out else run

    # ---- stage 3: tables -----------------------------------------------------------------

    def tables(self, run: Run, midline: bool = False) -> Run:
        if not any("{" in x if isinstance(x, str) else x.marker == "table_open" for x in run):
            return run
        p = self.project(run)
        t, g = p.text, self.g
        if "{|" not in t and self.m.char["table_open"] not in t and "{" + self.m.char["bar"] not in t:
            return run
        out: Run = []
        # An open table: its node, and where content goes just now.
        stack: list[dict] = []

        def sink() -> Run:
            if not stack:
                return out
            x = stack[-1]
            if x["cell"] is not None:
                return x["cell"]
            holder = x["row"] or x["table"]
            if not holder.children or holder.children[-1].subtype != "table-inter":
                holder.children.append(Node("PLAIN", "table-inter"))
            return holder.children[-1].children

        def table_attrs(a: int, b: int, name: str) -> Node:
            return Node("ATTRIBUTES", "table-attrs", self.attributes(p.cut(a, b), "table", name), name=name)

        for i, (a, b) in enumerate(self._lines(t)):
            line, brk = t[a:b], "\n" if i else ""
            m = g.table_open.match(line) if not (midline and not i) else None
            if m:
                if brk:
                    sink().append(brk)
                if m[1]:
                    sink().extend(p.cut(a, a + m.end(1)))
                if m[2]:
                    sink().append(Node("DD", "dd", [m[2]], marker="list"))
                sink().extend(p.cut(a + m.start(3), a + m.end(3)))
                table = Node("TABLE", "table", [Node("SYNTAX", "table-syntax", p.cut(a + m.start(4), a + m.end(4))), table_attrs(a + m.end(), b, "table")], name="table", marker="table")
                sink().append(table)
                stack.append({"table": table, "row": None, "cell": None, "kind": "td"})
                continue
            if not stack:
                out.extend([brk, *p.cut(a, b)])
                continue
            x = stack[-1]
            if m := g.table_close.match(line):
                x["table"].children.append(Node("SYNTAX", "table-syntax", [brk, *p.cut(a, a + m.end())]))
                stack.pop()
                sink().extend(p.cut(a + m.end(), b))
            elif m := g.table_row.match(line):
                x["row"] = Node("TR", "tr", [Node("SYNTAX", "table-syntax", [brk, *p.cut(a, a + m.end())]), table_attrs(a + m.end(), b, "tr")], name="tr")
                x["table"].children.append(x["row"])
                x["cell"] = None
            elif " " not in line and (m := g.table_cell.match(line)):
                kind = "caption" if m["cap"] else "th" if m["head"] else "td"
                syntax: Run = [brk, *p.cut(a, a + m.end())]
                at = a + m.end()
                splits = [] if kind == "caption" else [(at + s.start(), at + s.end()) for s in (g.head_split if kind == "th" else g.cell_split).finditer(t[at:b])]
                for s, e in [*splits, (b, b)]:
                    self._cell(p, x, syntax, at, s, kind)
                    syntax, at = p.cut(s, e), e
                    if t[s:e] == "!!":
                        kind = "th"
            else:
                sink().extend([brk, *p.cut(a, b)])
        return join(out)

    def _cell(self, p: Projection, x: dict, syntax: Run, a: int, b: int, kind: str) -> None:
        t = p.text[a:b]
        m = self.g.bar.search(t)
        attrs, inner, at = [], "", a
        if m and "[[" not in t[: m.start()] and "-{" not in t[: m.start()]:
            attrs, inner, at = p.cut(a, a + m.start()), m[0], a + m.end()
            inner = "{{!}}" if inner != "|" else "|"
        content = Node("PLAIN", "td-inner", p.cut(at, b))
        kids = [Node("SYNTAX", "table-syntax", syntax), Node("ATTRIBUTES", "table-attrs", self.attributes(attrs, "table", kind), name=kind), content]
        cell = Node("TD", "td", kids, name=kind, data={"inner_syntax": inner, "bar": p.cut(a + m.start(), a + m.end()) if inner else []})
        (x["row"] or x["table"]).children.append(cell)
        x["cell"] = content.children

    # ---- stage 4: rules, switches, headings ----------------------------------------------

    def line_marks(self, run: Run, heading: bool = True) -> Run:
        if not any(isinstance(x, str) and ("=" in x or "----" in x or "__" in x or "＿＿" in x) for x in run):
            return run
        p = self.project(run)
        t = p.text
        out: Run = []
        for i, (a, b) in enumerate(self._lines(t)):
            if i:
                out.append("\n")
            line = t[a:b]
            if line.startswith("=") or (heading and "=" in line and self.m.any_re.sub("", line).startswith("=")):
                skip = len(line) - len(line.lstrip("".join(self.m.char[c] for c in ("comment", "silent"))))
                m = self.g.heading.match(line, skip) if heading and "heading" not in self.config.excludes else None
                if m:
                    out += p.cut(a, a + skip)
                    if m[5]:
                        n = min(6, (len(m[5]) - 1) // 2)
                        lo, hi, trail = a + m.start(5) + n, a + m.end(5) - n, p.cut(a + m.start(6), b)
                    else:
                        n = min(6, len(m[1]), len(m[3]))
                        lo, hi, trail = a + m.start(1) + n, a + m.end(3) - n, p.cut(a + m.start(4), b)
                    title = self.switches(p.cut(lo, hi))
                    out.append(Node("HEADING", "heading", [Node("PLAIN", "heading-title", title), Node("SYNTAX", "heading-trail", trail)], name=str(n), data={"level": n}, marker="heading"))
                    continue
            if "----" in line and (m := self.g.hr.match(line)):
                out += [*p.cut(a, a + m.end(1)), Node("HR", "hr", [m[2]], marker="rule")]
                out += self.switches(p.cut(a + m.end(), b))
                continue
            out += self.switches(p.cut(a, b))
        return join(out)

    def switches(self, run: Run) -> Run:
        if not any(isinstance(x, str) and ("__" in x or "＿＿" in x) for x in run):
            return run
        p, out, done = self.project(run), [], 0
        c = self.config
        for m in self.g.switch.finditer(p.text):
            word = m[2]
            cs = word in c.switches_cs
            if not cs and word.lower() not in c.switches_ci or m[1] != m[3]:
                continue
            alias = c.switches_cs[word] if cs else c.switches_ci[word.lower()]
            out += [*p.cut(done, m.start()), Node("DOUBLE_UNDERSCORE", "double-underscore", [word], name=alias.lower(), data={"case_sensitive": cs, "fullwidth": m[1] != "__"}, marker="switch")]
            done = m.end()
        return [*out, *p.cut(done, len(p.text))]

    # ---- stage 5: links, files, categories -----------------------------------------------

    def links(self, run: Run, in_ext: bool = False) -> Run:
        if not any(isinstance(x, str) and "[[" in x for x in run):
            return run
        p = self.project(run)
        t = p.text
        out: Run = []
        # Open pairs: where each starts in the text and in ``out``, its target, and whether a link stands in it. What
        # is no link stays in ``out`` as it is, so every piece moves into a node at most once.
        opened: list[list] = []
        at = done = 0
        while m := self._PAIR.search(t, at):
            out += p.cut(done, m.start())
            done = at = m.end()
            if m[0] == "[[":
                target = self.g.link_target.match(t, m.start())
                opened.append([len(out), target, len(out), False])
                out.append("[[")
                if target:
                    out += p.cut(m.end(), target.end())
                    opened[-1][2] = len(out)
                    done = at = target.end()
                continue
            if not opened:
                out.append("]]")
                continue
            first, target, inner, holds_link = opened.pop()
            node = None
            if target:
                text = (target.end(), m.start()) if target[2] is not None else (-1, -1)
                if text[0] >= 0 and t.startswith("]", m.end()) and (single := t.rfind("[", *text)) >= 0 and t[single - 1] != "[":
                    # The label of an external link ends with the text: its bracket is the first of three.
                    text = (text[0], m.start() + 1)
                    out.append("]")
                    done = at = m.end() + 1
                node = self._link(p, target, out[inner:] if text[0] >= 0 else None, holds_link, in_ext)
            if node is None:
                out.append("]]")
            else:
                del out[first:]
                out.append(node)
            if opened and (holds_link if node is None else node.subtype == "link" or holds_link):
                opened[-1][3] = True
        return join([*out, *p.cut(done, len(t))])

    _PAIR = re.compile(r"\[\[|\]\]")

    def _link(self, p: Projection, target: re.Match[str], content: Run | None, holds_link: bool, in_ext: bool) -> Node | None:
        raw = target[1]
        if any(self.m.char[k] in raw for k in ("extension", "tag", "heading", "table", "rule", "switch", "link")) or self.g.protocol.match(raw.strip()):
            return None
        dynamic = bool(self.m.any_re.search(raw))
        bare = self.m.any_re.sub("", raw).strip(WIDE_SPACE)
        forced = bare.startswith(":")
        title = parse_title(bare, self.config, 0, self.title)
        if not title.valid and not (dynamic and not bare.strip(":#")):
            return None
        kind = ("LINK", "link")
        if not forced and not title.interwiki:
            kind = {6: ("FILE", "file"), 14: ("CATEGORY", "category")}.get(title.ns, kind)
        # Only files may hold links; a link around another one is text.
        if kind[0] != "FILE" and (holds_link or (content is not None and any(isinstance(x, Node) and x.marker == "link" for x in content))):
            return None
        if in_ext and kind[0] == "LINK" and content is not None and not content:
            return None
        name = p.cut(*target.span(1))
        node = Node(*kind, children=[Node("ATOM", "link-target", name)], name=title.title if title.valid else visible(name).strip(), sep="|", marker="link")
        if target[2] is not None:
            node.data["magic_pipe"] = target[2] != "|"
            node.data["bar"] = p.cut(*target.span(2))
        node.data |= {"forced": forced, "interwiki": title.interwiki, "ns": title.ns, "fragment": title.fragment}
        if content is not None:
            node.children += self.image_parameters(content, node.name) if kind[0] == "FILE" else [Node("PLAIN", "link-text", join(content))]
        return node

    _WIDTH = re.compile(r"(?:\d+x?|\d*x\d+)(?:\s*px)?\Z")

    _BARS = re.compile(r"\[\[|\]\]|\{\{|\}\}|-\{|\}-|\|")
    _CLOSES = {"]]": "[[", "}}": "{{", "}-": "-{"}

    def _bars(self, t: str) -> list[int]:
        """Bars outside closed pairs; those behind an opening that is never closed count."""
        bars: list[int] = []
        opened: list[tuple[str, int]] = []
        for m in self._BARS.finditer(t):
            if m[0] == "|":
                bars.append(m.start())
            elif m[0] in self._CLOSES.values():
                opened.append((m[0], len(bars)))
            else:
                k = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == self._CLOSES[m[0]]), None)
                if k is not None:
                    del bars[opened[k][1] :]
                    del opened[k:]
        return bars

    def image_parameters(self, run: Run, title: str, lenient: bool = False) -> Run:
        # Links with a label first, as a bar in an address or label parts nothing.
        p = self.project(self.ext_links(run))
        out: Run = []
        spots = self._bars(p.text)
        for a, b in zip([0, *(i + 1 for i in spots)], [*spots, len(p.text)], strict=True):
            out.append(self._image_parameter(p.cut(a, b), p.text[a:b], title.rpartition(".")[2].lower(), lenient))
        return out

    _NUMBER = re.compile(r"\d*\.?\d+\Z")
    _ADDRESS = re.compile(r"[^\s<>\[\]\"|]+\Z")

    def _valid_option(self, name: str, inner: str, extension: str, lenient: bool) -> bool:
        """Whether an option's value is one that the option takes; ``lenient``: links of galleries take any."""
        value = self.m.any_re.sub("", inner).strip()
        match name:
            case "alt" | "class" | "manualthumb":
                return True
            case "lang":
                return extension in ("svg", "svgz") and bool(re.fullmatch(r"[a-z\d-]+", value))
            case "page":
                return extension in ("djvu", "djv", "pdf") and bool(self._NUMBER.match(value)) and float(value) > 0
            case "width":
                return bool(self._WIDTH.match(value)) or (not value and bool(inner))
            case "link":
                if lenient or not value or self.m.char["link"] in inner or self.m.char["address"] in inner:
                    return True
                if self.g.protocol.match(value):
                    return bool(self._ADDRESS.match(value))
                return parse_title(value.removeprefix("[[").removesuffix("]]"), self.config, 0, self.title).valid
        return bool(self._NUMBER.match(value)) or (not value and self.m.char["call"] in inner)

    def _image_parameter(self, run: Run, t: str, extension: str, lenient: bool) -> Node:
        core = t.strip()
        lead, tail = t[: len(t) - len(t.lstrip())], t[len(t.rstrip()) :] if core else ""
        if core in self.g.image_words:
            return Node("PLAIN", "image-parameter", run, name=self.g.image_words[core], data={"raw_syntax": f"{lead}{core}{tail}"})
        for pattern, key, name in self.g.image:
            m = pattern.match(core)
            if not m:
                continue
            if not self._valid_option(name, m[1], extension, lenient):
                continue
            a = len(lead) + m.start(1)
            inner = self.project(run).cut(a, a + len(m[1]))
            return Node("PLAIN", "image-parameter", inner, name=name, data={"raw_syntax": f"{lead}{key}{tail}"})
        return Node("PLAIN", "image-parameter", run, name="caption")

    # ---- stage 6: quotes -----------------------------------------------------------------

    _TICKS = re.compile(r"'{2,}")

    def quotes(self, run: Run) -> Run:
        if not any(isinstance(x, str) and "''" in x for x in run):
            return run
        p = self.project(run)
        out: Run = []
        for i, (a, b) in enumerate(self._lines(p.text)):
            if i:
                out.append("\n")
            out += self._quote_line(p, a, b)
        return join(out)

    def _quote_line(self, p: Projection, a: int, b: int) -> Run:
        line = p.text[a:b]
        # Of each run, what is literal and how many are marks: 2, 3 or 5.
        runs = [[m.start(), m.end(), {2: 2, 3: 3, 4: 3}.get(len(m[0]), 5)] for m in self._TICKS.finditer(line)]
        if not runs:
            return p.cut(a, b)
        bold, italic = sum(r[2] in (3, 5) for r in runs), sum(r[2] in (2, 5) for r in runs)
        if bold % 2 and italic % 2:
            # One bold mark is an apostrophe and an italic one: best behind a one-letter word, else a longer word, else a blank.
            def rank(r: list[int]) -> tuple[int, int]:
                s = r[1] - 3
                before, second = line[s - 1 : s], line[s - 2 : s - 1] if s >= 2 else ""
                return (2 if before in ("", " ") else 0 if second in ("", " ") else 1, r[0])

            bolds = [r for r in runs if r[2] == 3]
            if bolds:
                min(bolds, key=rank)[2] = 2
        out: Run = []
        done = 0
        for s, e, n in runs:
            out += [*p.cut(a + done, a + e - n), Node("QUOTE", "quote", ["'" * n], data={"bold": n != 2, "italic": n != 3}, marker="quote")]
            done = e
        return [*out, *p.cut(a + done, b)]

    # ---- stage 7 and 8: external links, magic links --------------------------------------

    def ext_links(self, run: Run) -> Run:
        if not any(isinstance(x, str) and "[" in x for x in run):
            return run
        p, out, done = self.project(run), [], 0
        for m in self.g.ext_link.finditer(p.text):
            kids: Run = [Node("MAGIC_LINK", "ext-link-url", p.cut(*m.span(1)))]
            if m[3]:
                kids.append(Node("PLAIN", "ext-link-text", p.cut(*m.span(3))))
            out += [*p.cut(done, m.start()), Node("EXT_LINK", "ext-link", kids, data={"space": m[2]}, marker="external")]
            done = m.end()
        return [*out, *p.cut(done, len(p.text))] if out else run

    _MAGIC = re.compile(r"[:/]|RFC|PMID|ISBN")

    def magic_links(self, run: Run) -> Run:
        if not any(isinstance(x, str) and self._MAGIC.search(x) for x in run):
            return run
        p, out, done = self.project(run), [], 0
        for m in self.g.free.finditer(p.text):
            end = m.end()
            if m["url"]:
                url = m["url"]
                cut = re.search(r"&(?:lt|gt|nbsp|#x0*(?:3[CcEe]|[Aa]0)|#0*(?:60|62|160));", url)
                if cut:
                    url = url[: cut.start()]
                trim = ",;\\.:!?" + ("" if "(" in url else ")")
                url = url.rstrip(trim) if not re.search(r"&[A-Za-z#0-9]+;$", url) else url
                if self.g.protocol.fullmatch(url) or not url:
                    continue
                end = m.start() + len(url)
                node = Node("MAGIC_LINK", "free-ext-link", p.cut(m.start(), end), marker="external")
            else:
                kind = next(k for k in ("RFC", "PMID", "ISBN") if m[0].startswith(k))
                node = Node("MAGIC_LINK", "magic-link", p.cut(m.start(), end), name=kind, marker="magic")
            out += [*p.cut(done, m.start()), node]
            done = end
        return [*out, *p.cut(done, len(p.text))] if out else run

    # ---- stage 9: lists ------------------------------------------------------------------

    _LIST_SIGN = re.compile(r"[*#:;]")

    def lists(self, run: Run, midline: bool = False) -> Run:
        if not any(isinstance(x, str) and self._LIST_SIGN.search(x) for x in run) or "list" in self.config.excludes:
            return run
        p = self.project(run)
        t = p.text
        out: Run = []
        before = ""
        for i, (a, b) in enumerate(self._lines(t)):
            if i:
                out.append("\n")
            m = self.g.list.match(t, a, b) if i or not midline else None
            if not m:
                before = ""
                out += p.cut(a, b)
                continue
            out += p.cut(a, m.end(1))
            parts, terms = self._list_marks(m[2], before)
            before = m[2].replace(";", ":")
            for x in parts:
                kind = ("LIST", "list") if x.strip(":") else ("DD", "dd")
                out.append(Node(*kind, [x], data={"indent": x.count(":")}, marker="list"))
            at = m.end()
            # Terms and their definitions on one line: as many colons as there are new terms.
            for s, e in self._definitions(p, at, b, terms):
                out += [*p.cut(at, s), Node("DD", "dd", [t[s:e]], data={"indent": e - s}, marker="list")]
                at = e
            out += p.cut(at, b)
        return join(out)

    _TERM = re.compile(r"(?=;)")

    def _list_marks(self, marks_: str, before: str) -> tuple[list[str], int]:
        """The marks of a line, parted in front of each term, and how many terms the line opens.

        ``before`` are the marks of the line above, with colons for terms: what both lines share, but
        for its last mark, goes on from there and is parted only if a term follows it.
        """
        shared = 0
        for x, y in zip(marks_.replace(";", ":"), before, strict=False):
            if x != y:
                break
            shared += 1
        goes_on = marks_[: max(0, shared - 1)]
        new = [x for x in self._TERM.split(marks_[len(goes_on) :]) if x]
        if new[0][0] != ";":
            return [goes_on + new[0], *new[1:]], len(new) - 1
        old = [x for x in self._TERM.split(goes_on) if x]
        return [*old, *new], len(new) + (len(old) if ";" in goes_on else 0)

    _DEFINITION = re.compile(r":+|-\{|\}-")

    def _definitions(self, p: Projection, a: int, b: int, terms: int) -> list[tuple[int, int]]:
        """The colon runs of text[a:b] that begin definitions: outside variants, and where no tag or quote is open."""
        if not terms or ":" not in p.text[a:b]:
            return []
        spans: list[tuple[int, int]] = []
        k = bisect_left(p.at, a)
        depth, bold, italic = 0, False, False
        for m in self._DEFINITION.finditer(p.text, a, b):
            while k < len(p.at) and p.at[k] < m.start():
                node = p.nodes[k]
                k += 1
                if node.type == "HTML" and not node.data["self_closing"] and node.name not in self.config.html_void:
                    depth = max(0, depth + (-1 if node.data["closing"] else 1))
                elif node.type == "'":
                    bold, italic = bold ^ node.data["bold"], italic ^ node.data["italic"]
            if m[0] == "-{":
                depth += 1
            elif m[0] == "}-":
                depth = max(0, depth - 1)
            elif not depth and not bold and not italic and not p.text.startswith("//", m.end()):
                n = min(terms, m.end() - m.start())
                spans.append((m.start(), m.start() + n))
                terms -= n
                if not terms:
                    break
        return spans

    # ---- stage 10: language variants -----------------------------------------------------

    _VARIANT = re.compile(r"-\{((?:(?!-\{|\}-).)*)\}-", re.S)

    def converters(self, run: Run) -> Run:
        if not self.config.variants or not any(isinstance(x, str) and "-{" in x for x in run):
            return run
        while True:
            p, out, done = self.project(run), [], 0
            for m in self._VARIANT.finditer(p.text):
                out += [*p.cut(done, m.start()), self._converter(p, *m.span(1))]
                done = m.end()
            run = [*out, *p.cut(done, len(p.text))]
            if not done:
                return run

    def _converter(self, p: Projection, a: int, b: int) -> Node:
        t = p.text
        bar = t.find("|", a, b)
        flags = Node("PLAIN", "converter-flags", [], sep=";")
        node = Node("CONVERTER", "converter", [flags], marker="variant", data={"bar": bar >= 0})
        if bar >= 0:
            at = a
            for f in t[a:bar].split(";"):
                flags.children.append(Node("PLAIN", "converter-flag", p.cut(at, at + len(f))))
                at += len(f) + 1
            a = bar + 1
        at = a
        names = "|".join(sorted(map(re.escape, self.config.variants), key=len, reverse=True))
        rule = re.compile(rf"(?:(.*?)(=>))?(\s*(?:{names})\s*):(.*)\Z", re.S)
        for part in re.split(rf";(?=(?:(?!;).)*?(?:{names})\s*:|\s*\Z)", t[a:b]) if re.search(rf"(?:{names})\s*:", t[a:b]) else [t[a:b]]:
            m = rule.match(part)
            kids: Run = []
            if m:
                if m[2]:
                    kids.append(Node("PLAIN", "converter-rule-from", p.cut(at, at + len(m[1]))))
                kids += [Node("PLAIN", "converter-rule-variant", [m[3]]), Node("PLAIN", "converter-rule-to", p.cut(at + m.start(4), at + m.end(4)))]
            else:
                kids.append(Node("PLAIN", "converter-rule-to", p.cut(at, at + len(part))))
            node.children.append(Node("PLAIN", "converter-rule", kids, name=m[3].strip() if m else None, sep=":"))
            at += len(part) + 1
        return node

    # ---- driver --------------------------------------------------------------------------

    #: Without one of these no stage finds anything in a text.
    _TRIGGER = re.compile(r"[<\[{'=*#:;]|__|----|＿＿|-\{|//|RFC|PMID|ISBN", re.I)

    def pipeline(self, run: Run, stages, in_ext: bool = False, midline: bool = False, heading: bool = True) -> Run:  # noqa: ANN001
        if not any(isinstance(x, str) and self._TRIGGER.search(x) for x in run) and not any(isinstance(x, Node) and x.marker in ("bar", "table_open") for x in run):
            return join(run)
        steps: dict[int, Callable[[Run], Run]] = {
            0: lambda r: self.comments(r, in_ext), 1: self.braces, 2: self.html, 3: lambda r: self.tables(r, midline), 4: lambda r: self.line_marks(r, heading), 5: lambda r: self.links(r, in_ext),
            6: self.quotes, 7: self.ext_links, 8: self.magic_links, 9: lambda r: self.lists(r, midline), 10: self.converters,
        }
        for s in stages:
            run = steps[s](run)
        return join(run)

    def finish(self, root: Node, max_stage: int) -> None:
        """Parse the contents that have a context of their own, from the outside in."""
        todo: list[tuple[Node, bool, str | None]] = [(root, False, None)]
        while todo:
            node, in_ext, tag = todo.pop()
            node.in_ext = in_ext
            if node.type == "EXT" or node.subtype in ("html-attrs", "table-attrs"):
                tag = node.name
            stages = CONTEXTS.get(node.subtype)
            if stages and node.subtype == "ext-inner" and (node.name not in PARSED_EXT or node.name in ("gallery", "imagemap", "inputbox", "dynamicpagelist", "references", "categorytree")):
                stages = None
            if node.type == "EXT_ATTR" and (found := ATTR_CONTEXTS.get((tag, node.name)) or ATTR_CONTEXTS.get((None, node.name))):
                value = node.children[1]
                value.children = self.pipeline(value.children, [s for s in found if s <= max_stage], True) or value.children
            if stages:
                if node.subtype == "image-parameter" and node.name not in ("caption", "alt", "link"):
                    stages = None
                elif node.subtype == "image-parameter" and node.name != "caption":
                    stages = (10,)
                else:
                    stages = [s for s in stages if s <= max_stage]
            if stages:
                heading = node.subtype not in NO_HEADING and not (node.subtype == "ext-inner" and node.name in NO_HEADING)
                node.children = self.pipeline(node.children, stages, in_ext or node.subtype == "ext-inner", node.subtype in MIDLINE, heading)
            inside = in_ext or node.subtype == "ext-inner"
            todo.extend((x, inside, tag) for x in node.children if isinstance(x, Node))


def parse(text: str | None, config: SiteConfig | None = None, include: bool = False, page: str | None = None, max_stage: int = MAX_STAGE) -> Node:
    """The tree of one page; null and empty texts give an empty root."""
    config = config or _default()
    source = tidy(text or "")
    p = Page(config, block_for(source), include, page)
    run: Run = p.redirect([source]) if source else []
    run = p.pipeline(run, range(0, max_stage + 1))
    root = Node("ROOT", "root", run, data={"include": include})
    p.finish(root, max_stage)
    return root


@lru_cache(maxsize=1)
def _default() -> SiteConfig:
    return default()


__all__ = ["CONTEXTS", "Page", "decode_entities", "normalize", "parse", "tidy"]
