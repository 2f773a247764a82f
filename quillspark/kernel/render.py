"""Readers of a tree: plain text, Markdown, HTML, list items."""

from __future__ import annotations

import html as _html
import re
import sys
from urllib.parse import quote

from quillspark.kernel.model import Node, Run
from quillspark.kernel.serialize import to_text

BASE_URL = "/wiki/"
# Extension tags shown as code, and those left out.
CODE_EXT = {"syntaxhighlight", "source", "pre", "score", "timeline"}
SKIP_EXT = {"templatedata", "templatestyles", "indicator", "section", "inputbox", "categorytree", "dynamicpagelist", "graph"}


def kids_of(node: Node, subtype: str) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.subtype == subtype]


def plain_text(root: Node) -> str:
    """What a reader sees, without markup: no comments, categories, redirect syntax, heading trails or template calls."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        t = x.subtype
        if t in ("comment", "category", "redirect-syntax", "heading-trail", "html", "template", "magic-word", "double-underscore", "table-syntax", "table-attrs", "ext-attrs", "quote", "list", "dd", "include", "noinclude", "hr"):
            continue
        if t in ("link", "redirect-target"):
            text = kids_of(x, "link-text")
            todo.extend(reversed(text[0].children if text and text[0].children else kids_of(x, "link-target")[0].children))
        elif t in ("file", "gallery-image", "imagemap-image"):
            captions = [p for p in kids_of(x, "image-parameter") if p.name == "caption"]
            todo.extend(reversed(captions[-1].children if captions else []))
        elif t == "ext-link":
            text = kids_of(x, "ext-link-text")
            todo.extend(reversed(text[0].children if text else []))
        elif t == "ext":
            todo.extend(reversed([] if x.name in SKIP_EXT or x.name in ("ref", "references", "gallery", "imagemap") else x.children))
        elif t == "arg":
            todo.extend(reversed(kids_of(x, "arg-default")[:1]))
        elif t == "td":
            todo.extend(["\t", *reversed(kids_of(x, "td-inner"))])
        elif t == "converter":
            rules = kids_of(x, "converter-rule")
            todo.extend(reversed(kids_of(rules[0], "converter-rule-to") if rules else []))
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def target_url(title: str, base: str = BASE_URL) -> str:
    return base + quote(title.replace(" ", "_"), safe="/:#()',_-.~!*")


class Markdown:
    """One page to Markdown; keeps the footnotes that come up on the way."""

    #: Handlers by role, and by class for roles that have none of their own.
    BY_ROLE: dict[str, str] = {
        **dict.fromkeys(("comment", "category", "double-underscore", "redirect-syntax", "heading-trail", "table-attrs", "ext-attrs", "html-attrs", "include", "noinclude"), "_none"),
        **{r: "on_" + r.replace("-", "_") for r in "redirect heading link file quote ext-link free-ext-link list dd hr html table template magic-word arg converter ext".split()},
        "gallery-image": "on_file", "imagemap-image": "on_file",
    }
    BY_CLASS: dict[str, str] = {"COMMENT": "_none", "NOINCLUDE": "_none", "FILE": "on_file", "LINK": "on_link", "TABLE": "on_table", "TRANSCLUDE": "on_template", "QUOTE": "on_quote"}

    def __init__(self, base: str = BASE_URL) -> None:
        self.base = base
        self.notes: dict[str, list[str]] = {}
        self.order: list[str] = []
        self.bold = self.italic = self.in_table = False

    def page(self, root: Node) -> str:
        body = self.run(root.children)
        body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
        if self.order:
            body += "\n\n" + "\n".join(f"[^{i}]: {self.notes[i][0]}" for i in self.order)
        return body

    def run(self, run: Run) -> str:
        return "".join([x if isinstance(x, str) else self.node(x) for x in run])

    def node(self, n: Node) -> str:
        """By the node's role, else by its class; what has no handler shows its contents."""
        name = self.BY_ROLE.get(n.subtype) or self.BY_CLASS.get(n.type)
        return getattr(self, name)(n) if name else self.run(n.children)

    def _none(self, n: Node) -> str:
        return ""


    def on_redirect(self, n: Node) -> str:
        t = kids_of(n, "redirect-target")[0]
        shown = n.data.get("display") or n.data["link"]
        return f"Redirect: [{shown.strip()}]({target_url(t.name, self.base)})\n"

    def on_heading(self, n: Node) -> str:
        return "#" * n.data["level"] + " " + self.run(kids_of(n, "heading-title")).strip()

    def on_link(self, n: Node) -> str:
        text = kids_of(n, "link-text")
        shown = self.run(text) if text and text[0].children else to_text(kids_of(n, "link-target")[0]).lstrip(":")
        fragment = f"#{n.data['fragment']}" if n.data.get("fragment") else ""
        return f"[{shown}]({target_url((n.name or '') + fragment, self.base)})"

    def on_file(self, n: Node) -> str:
        params = kids_of(n, "image-parameter")
        alt = [p for p in params if p.name == "alt"] or [p for p in params if p.name == "caption"]
        return f"![{self.run(alt[-1].children).strip() if alt else ''}]({target_url(n.name or '', self.base)})"

    def on_quote(self, n: Node) -> str:
        return ("**" if n.data["bold"] else "") + ("*" if n.data["italic"] else "")

    def on_ext_link(self, n: Node) -> str:
        url = to_text(kids_of(n, "ext-link-url")[0])
        text = kids_of(n, "ext-link-text")
        return f"[{self.run(text)}]({url})" if text else f"<{url}>"

    def on_free_ext_link(self, n: Node) -> str:
        return f"<{self.run(n.children)}>"

    def on_list(self, n: Node) -> str:
        m = to_text(n)
        own = {"*": "- ", "#": "1. ", ";": "**", ":": ": "}[m[-1]]
        return "  " * (len(m) - 1) + (own if own != "**" else "- ")

    def on_dd(self, n: Node) -> str:
        return "  " * len(to_text(n)) + ": " if n.children else ""

    def on_hr(self, n: Node) -> str:
        return "\n---\n"

    def on_html(self, n: Node) -> str:
        name, closing = n.name, n.data["closing"]
        if name in ("b", "strong"):
            return "**"
        if name in ("i", "em", "cite", "var"):
            return "*"
        if name in ("code", "tt", "kbd", "samp"):
            return "`"
        if name in ("s", "del", "strike"):
            return "~~"
        if name == "br":
            return "  \n"
        if name == "hr":
            return "\n---\n"
        if name in ("p", "div", "center", "blockquote"):
            return "\n" if closing else "\n> " if name == "blockquote" else "\n"
        if name == "li" and not closing:
            return "\n- "
        return ""

    def on_table(self, n: Node) -> str:
        rows: list[list[str]] = []
        caption = ""
        inner, self.in_table = self.in_table, True
        for row in [n, *kids_of(n, "tr")]:
            cells = []
            for td in kids_of(row, "td"):
                text = re.sub(r"\s*\n\s*", " ", self.run(kids_of(td, "td-inner"))).strip()
                if td.name == "caption":
                    caption = text
                else:
                    cells.append(text if inner else text.replace("|", "\\|"))
            if cells:
                rows.append(cells)
        self.in_table = inner
        if inner:
            # A cell can't hold a table: its cells follow each other.
            return " ".join(x for x in [caption, *[c for r in rows for c in r]] if x)
        if not rows:
            return caption
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        lines.insert(1, "|" + " --- |" * width)
        return (f"{caption}\n\n" if caption else "") + "\n".join(lines)

    def on_template(self, n: Node) -> str:
        import json

        params = {p.name: "".join(map(to_text, kids_of(p, "parameter-value"))) for p in kids_of(n, "parameter")}
        return "`" + json.dumps({"template": n.name, "params": params}, ensure_ascii=False).replace("`", "'") + "`"

    def on_magic_word(self, n: Node) -> str:
        return {"!": "|", "=": "="}.get(n.name or "", f"`{to_text(n)}`")

    def on_arg(self, n: Node) -> str:
        default = kids_of(n, "arg-default")
        return self.run(default[0].children) if default else f"`{to_text(n)}`"

    def on_converter(self, n: Node) -> str:
        rules = kids_of(n, "converter-rule")
        return self.run(kids_of(rules[0], "converter-rule-to")) if rules else ""

    def on_ext(self, n: Node) -> str:
        inner = n.data.get("ext_inner") or ""
        if n.name == "ref":
            return self._note(n)
        if n.name in SKIP_EXT:
            return ""
        if n.name in CODE_EXT:
            lang = next((to_text(a.children[1]) for a in kids_of(n, "ext-attrs")[0].children if isinstance(a, Node) and a.name == "lang" and len(a.children) > 1), "")
            code = inner.strip("\n")
            return f"\n```{lang}\n{code}\n```\n"
        if n.name in ("math", "chem", "ce"):
            return f"${inner}$"
        if n.name == "nowiki":
            return inner
        if n.name == "poem":
            return "  \n".join(self.run(kids_of(n, "ext-inner")).strip("\n").split("\n"))
        return self.run(kids_of(n, "ext-inner"))

    def _note(self, n: Node) -> str:
        name = next((to_text(a.children[1]).strip() for a in kids_of(n, "ext-attrs")[0].children if isinstance(a, Node) and a.name == "name" and len(a.children) > 1), "")
        text = re.sub(r"\s+", " ", self.run(kids_of(n, "ext-inner"))).strip()
        key = re.sub(r"[^\w-]+", "-", name).strip("-") if name else str(len(self.order) + 1)
        if not name:
            while key in self.notes:
                key += "-"
        if key not in self.notes:
            self.notes[key] = [text]
            self.order.append(key)
        elif text and not self.notes[key][0]:
            self.notes[key][0] = text
        return f"[^{key}]"


def tree_depth(root: Node) -> int:
    deepest, todo = 0, [(root, 1)]
    while todo:
        n, d = todo.pop()
        deepest = max(deepest, d)
        todo.extend((c, d + 1) for c in n.children if isinstance(c, Node))
    return deepest


def _rendered(reader: Markdown, root: Node) -> str:
    """A page by a reader that calls itself per level; such calls take heap, so any depth will do."""
    before = sys.getrecursionlimit()
    # At most three calls a level.
    sys.setrecursionlimit(max(before, 1000 + 4 * tree_depth(root)))
    try:
        return reader.page(root)
    finally:
        sys.setrecursionlimit(before)


def markdown(root: Node, base: str = BASE_URL) -> str:
    return _rendered(Markdown(base), root)


class Html(Markdown):
    """One page to simple HTML, by the same dispatch."""

    def page(self, root: Node) -> str:
        return self.run(root.children) + ("<ol>" + "".join(f'<li id="note-{k}">{self.notes[k][0]}</li>' for k in self.order) + "</ol>" if self.order else "")

    def run(self, run: Run) -> str:
        return "".join([_html.escape(x, quote=False) if isinstance(x, str) else self.node(x) for x in run])

    def on_heading(self, n: Node) -> str:
        k = n.data["level"]
        return f"<h{k}>{self.run(kids_of(n, 'heading-title')).strip()}</h{k}>"

    def on_link(self, n: Node) -> str:
        text = kids_of(n, "link-text")
        shown = self.run(text) if text and text[0].children else _html.escape(to_text(kids_of(n, "link-target")[0]).lstrip(":"))
        return f'<a href="{_html.escape(target_url(n.name or "", self.base))}">{shown}</a>'

    def on_ext_link(self, n: Node) -> str:
        url = to_text(kids_of(n, "ext-link-url")[0])
        text = kids_of(n, "ext-link-text")
        return f'<a href="{_html.escape(url)}">{self.run(text) if text else _html.escape(url)}</a>'

    def on_free_ext_link(self, n: Node) -> str:
        url = _html.escape(to_text(n))
        return f'<a href="{url}">{url}</a>'

    def on_file(self, n: Node) -> str:
        alt = [p for p in kids_of(n, "image-parameter") if p.name in ("alt", "caption")]
        return f'<img src="{_html.escape(target_url(n.name or "", self.base))}" alt="{_html.escape(plain_text(alt[-1]) if alt else "")}"/>'

    def on_quote(self, n: Node) -> str:
        out = ""
        if n.data["bold"]:
            self.bold = not self.bold
            out += "<b>" if self.bold else "</b>"
        if n.data["italic"]:
            self.italic = not self.italic
            out += "<i>" if self.italic else "</i>"
        return out

    def on_html(self, n: Node) -> str:
        return to_text(n)

    def on_hr(self, n: Node) -> str:
        return "<hr/>"

    def on_list(self, n: Node) -> str:
        return "<li>" + "&nbsp;" * (len(to_text(n)) - 1)

    def on_dd(self, n: Node) -> str:
        return self.on_list(n)

    def on_table(self, n: Node) -> str:
        def cells(row: Node) -> str:
            return "".join([f"<{c.name}>{self.run(kids_of(c, 'td-inner')).strip()}</{c.name}>" for c in kids_of(row, "td")])

        first = cells(n)
        return "<table>" + (f"<tr>{first}</tr>" if first else "") + "".join([f"<tr>{cells(r)}</tr>" for r in kids_of(n, "tr")]) + "</table>"

    def on_template(self, n: Node) -> str:
        return f"<code>{_html.escape(to_text(n))}</code>"

    def on_magic_word(self, n: Node) -> str:
        return {"!": "|", "=": "="}.get(n.name or "", f"<code>{_html.escape(to_text(n))}</code>")

    def on_ext(self, n: Node) -> str:
        if n.name == "ref":
            key = self._note(n)[2:-1]
            return f'<sup><a href="#note-{key}">[{self.order.index(key) + 1}]</a></sup>'
        if n.name in CODE_EXT | {"math", "nowiki", "chem", "ce"}:
            return f"<{'pre' if n.name in CODE_EXT else 'code'}>{_html.escape(n.data.get('ext_inner') or '')}</{'pre' if n.name in CODE_EXT else 'code'}>"
        return "" if n.name in SKIP_EXT else self.run(kids_of(n, "ext-inner"))


def html(root: Node, base: str = BASE_URL) -> str:
    return _rendered(Html(base), root)


def list_items(root: Node) -> list[tuple[int, str, int, bool, str, str | None]]:
    """(ordinal, markers, depth, ordered, item, definition) of every list line, wherever it stands."""
    out: list[tuple[int, str, int, bool, str, str | None]] = []
    todo: list[Node] = [root]
    while todo:
        n = todo.pop()
        kids = n.children
        i = 0
        while i < len(kids):
            x = kids[i]
            i += 1
            if not (isinstance(x, Node) and x.subtype in ("list", "dd")):
                continue
            marks, text, definition = to_text(x), [], None
            while i < len(kids) and isinstance(kids[i], Node) and kids[i].subtype in ("list", "dd"):
                # Marks of one line, parted in front of a term.
                marks += to_text(kids[i])
                i += 1
            while i < len(kids):
                y = kids[i]
                if isinstance(y, str) and "\n" in y:
                    text.append(y[: y.index("\n")])
                    i += 0 if isinstance(kids[i], Node) else 1
                    break
                if isinstance(y, Node) and y.subtype == "dd" and ";" in marks and definition is None:
                    definition, text = "".join(text), []
                else:
                    text.append(y if isinstance(y, str) else to_text(y))
                i += 1
            body = "".join(text).strip()
            term, rest = (definition.strip(), body) if definition is not None else (body, None)
            out.append((len(out), marks, len(marks), marks[-1:] == "#", term, rest))
        todo.extend(c for c in reversed(kids) if isinstance(c, Node))
    return out
