"""A tree back to text, to rows and to two shapes of JSON."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from quillspark.kernel.model import Node, Run


def _joined(parts: list[str], sep: str) -> str:
    return sep.join(parts)


def _pieces(node: Node) -> tuple[str, str, str]:
    """What stands before, between and behind the children's texts."""
    d = node.data
    match node.type:
        case "COMMENT":
            return "<!--", "", "-->" if d.get("closed") else ""
        case "LINK" | "CATEGORY" | "REDIRECT_TARGET" | "FILE":
            if node.subtype in ("gallery-image", "imagemap-image"):
                return "", "|", ""
            return "[[", "|", "]]"
        case "ARG":
            return "{{{", "|", "}}}"
        case "EXT_LINK":
            return "[", d.get("space") or "", "]"
        case "INCLUDE" | "TRANSLATE" | "ONLYINCLUDE":
            return d.get("open") or "", "", d.get("tag_closing") or ""
        case "REDIRECT":
            return d.get("pre") or "", "", d.get("post") or ""
        case "DOUBLE_UNDERSCORE":
            mark = "＿＿" if d.get("fullwidth") else "__"
            return mark, "", mark
    return "", node.sep, ""


def to_text(root: Node) -> str:
    """The text a tree was parsed from (after tidying)."""
    return _source(root, frozenset())[0]


def _source(root: Node, roles: frozenset[str]) -> tuple[str, dict[int, tuple[int, int]]]:
    """The text of a tree, and where in it the contents of the nodes of these roles stand, by the node's id; one pass."""
    out: list[str] = []
    spans: dict[int, tuple[int, int]] = {}
    at = 0
    # A stack of texts and nodes to come, last first; no recursion, so any depth will do.
    todo: list[Any] = [root]

    def push(*parts: Any) -> None:
        todo.extend(reversed(parts))

    def between(kids: Run, sep: Any) -> list[Any]:
        seq: list[Any] = []
        for i, k in enumerate(kids):
            # No separator beside the marks of a node's contents.
            if i and sep and not isinstance(k, int) and not isinstance(kids[i - 1], int):
                seq.extend(sep if isinstance(sep, list) else [sep])
            seq.append(k)
        return seq

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            at += len(x)
            continue
        if isinstance(x, int):
            # Met in front of a node's contents and behind them.
            spans[x] = (spans[x][0], at) if x in spans else (at, at)
            continue
        d, kids = x.data, x.children
        if x.subtype in roles:
            kids = [id(x), *kids, id(x)]
        if x.type == "EXT":
            head = [f"<{d['ext_name']}", kids[0]]
            push(*head, *(["/>"] if d["self_closing"] else [">", *kids[1:], d["ext_closing"] or ""]))
        elif x.type == "HTML":
            push("</" if d["closing"] else "<", d["orig_tag"], *kids, "/>" if d["self_closing"] else ">")
        elif x.type == "EXT_ATTR":
            value = [d["equal"], d["quote_open"] or "", kids[1], d["quote_close"] or ""] if d.get("equal") is not None else []
            push(kids[0], *value)
        elif x.type == "TRANSCLUDE":
            seq: list[Any] = ["{{", d.get("modifier") or "", kids[0]]
            for i, k in enumerate(kids[1:]):
                seq += [":" if not i and d.get("colon") else "|", k]
            push(*seq, "}}")
        elif x.type == "PARAMETER":
            push(*([] if d["anon"] else [kids[0], "="]), *kids[1:])
        elif x.type == "HEADING":
            marks = "=" * d["level"]
            push(marks, kids[0], marks, *kids[1:])
        elif x.type == "TD":
            push(kids[0], kids[1], *d.get("bar", []), *kids[2:])
        elif x.type == "CONVERTER":
            push("-{", kids[0], *(["|"] if d.get("bar") else []), *between(kids[1:], ";"), "}-")
        elif x.subtype == "converter-rule":
            seq = list(kids)
            push(*(between(seq, ":") if len(seq) < 3 else [seq[0], "=>", seq[1], ":", seq[2]]))
        elif x.subtype == "image-parameter" and d.get("raw_syntax") is not None:
            raw = d["raw_syntax"]
            if "$1" in raw:
                a, b = raw.split("$1", 1)
                push(a, *kids, b)
            else:
                push(*kids)
        elif x.type in ("LINK", "CATEGORY", "FILE") and d.get("magic_pipe"):
            push("[[", *between(kids, "|")[:1], *d["bar"], *between(kids[1:], "|"), "]]")
        else:
            before, sep, behind = _pieces(x)
            push(before, *between(kids, sep), behind)
    return "".join(out), spans


PAYLOAD = (
    ("level", "int"), ("closed", "boolean"), ("self_closing", "boolean"), ("closing", "boolean"), ("orig_tag", "string"), ("inner_syntax", "string"), ("case_sensitive", "boolean"), ("fullwidth", "boolean"),
    ("bold", "boolean"), ("italic", "boolean"), ("pre", "string"), ("post", "string"), ("link", "string"), ("display", "string"), ("ext_name", "string"), ("ext_attr", "string"), ("ext_inner", "string"), ("ext_closing", "string"),
    ("tag", "string"), ("attr", "string"), ("inner", "string"), ("tag_closing", "string"), ("equal", "string"), ("quote_open", "string"), ("quote_close", "string"), ("raw_syntax", "string"),
    ("space", "string"), ("magic_pipe", "boolean"), ("modifier", "string"), ("anon", "boolean"), ("module", "string"), ("function", "string"), ("forced", "boolean"), ("interwiki", "string"), ("ns", "int"), ("fragment", "string"),
    ("ordinal", "int"), ("parent_section", "int"), ("end_node", "int"), ("ref_name", "string"), ("number", "int"),
)
_FIELDS = frozenset(k for k, _ in PAYLOAD)
TOKEN_DDL = (
    "node_id int, parent_id int, child_ix int, depth int, subtree_end int, kind string, type string, subtype string, name string, sep string, text string, "
    "value string, in_ext_inner boolean, in_template boolean, in_ref boolean, payload struct<"
    + ", ".join(f"{k}: {t}" for k, t in PAYLOAD)
    + ">"
)


#: Roles whose source text stands in ``value``, so that views need not gather it from the leaves.
VALUE_ROLES = frozenset(
    "redirect-target link-target link-text template-name magic-word-name parameter-key parameter-value arg-name arg-default hidden heading-title heading-trail td-inner attr-key attr-value ext-inner "
    "image-parameter ext-link-url ext-link-text free-ext-link magic-link invoke-module invoke-function comment converter-flag converter-rule-from converter-rule-variant converter-rule-to "
    "list dd quote hr double-underscore noinclude include onlyinclude imagemap-link param-line html-attr-dirty ext-attr-dirty table-attr-dirty table-inter".split()
)


COLUMNS = tuple(x.split(":")[0].split()[0] for x in re.split(r", (?![^<]*>)", TOKEN_DDL))


def rows(root: Node, columns: Sequence[str] = COLUMNS, where: Mapping[str, Any] | None = None) -> list[tuple]:
    """Rows of these columns of TOKEN_DDL in document order; descendants of a node are those up to its subtree_end.

    Headings know their place among the page's headings, the section they stand in and the last
    node before the next heading of their level or above (null at the end of the page); footnotes
    know their name and number. What is not asked for is not made. With ``where``, only the rows
    that have these values in these columns are given.
    """
    out: list[list] = []
    source, spans = _source(root, VALUE_ROLES) if "value" in {*columns, *(where or ())} else ("", {})
    with_payload = "payload" in columns
    # Headings whose section is still open, by level; footnotes' numbers by name.
    sections: list[tuple[int, int, dict]] = []
    headings = 0
    numbers: dict[Any, int] = {}
    todo: list[tuple[Any, int, int, int, bool, bool]] = [(root, -1, 0, 0, False, False)]
    path: list[int] = []
    while todo:
        x, parent, ix, depth, in_t, in_r = todo.pop()
        node_id = len(out)
        # What is deeper than this node is complete.
        while len(path) > depth:
            out[path.pop()][4] = node_id - 1
        path.append(node_id)
        if isinstance(x, str):
            out.append([node_id, parent if parent >= 0 else None, ix, depth, node_id, "text", "TEXT", "text", None, None, x, None, None, in_t, in_r, None])
            continue
        payload = {k: v for k, v in x.data.items() if v is not None and k in _FIELDS} if x.data and with_payload else None
        if payload is not None and x.type == "HEADING":
            headings += 1
            level = payload["level"]
            while sections and sections[-1][0] >= level:
                sections.pop()[2]["end_node"] = node_id - 1
            payload |= {"ordinal": headings} | ({"parent_section": sections[-1][1]} if sections else {})
            sections.append((level, node_id, payload))
        elif payload is not None and x.type == "EXT" and x.name == "ref":
            name = next((to_text(a.children[1]) for a in x.children[0].children if isinstance(a, Node) and a.name == "name" and a.data.get("equal") is not None), None)
            number = numbers.setdefault(name if name is not None else node_id, len(numbers) + 1)
            payload |= {"number": number} | ({} if name is None else {"ref_name": name})
        value = source[slice(*spans.get(id(x), (0, 0)))] if x.subtype in VALUE_ROLES else None
        out.append([node_id, parent if parent >= 0 else None, ix, depth, node_id, "token", x.type, x.subtype, x.name, x.sep or None, None, value, x.in_ext, in_t, in_r, payload])
        in_t, in_r = in_t or x.type == "TRANSCLUDE", in_r or (x.type == "EXT" and x.name == "ref")
        todo.extend((c, node_id, i, depth + 1, in_t, in_r) for i, c in reversed(list(enumerate(x.children))))
    while path:
        out[path.pop()][4] = len(out) - 1
    if where:
        asked = [(COLUMNS.index(c), v) for c, v in where.items()]
        out = [r for r in out if all(r[k] == v for k, v in asked)]
    if tuple(columns) == COLUMNS:
        return [tuple(r) for r in out]
    pick = [COLUMNS.index(c) for c in columns]
    return [tuple([r[k] for k in pick]) for r in out]


def _derived(node: Node, inner: Callable[[Node], str]) -> dict[str, Any]:
    """Fields that follow from a node's own contents; ``inner`` gives the text of those."""
    d: dict[str, Any] = {}
    kids = node.children
    if node.subtype == "image-parameter":
        d["value"] = inner(node)
        if node.name == "width":
            w, _, h = d["value"].removesuffix("px").partition("x")
            d |= {"width": w, "height": h}
    elif node.subtype == "ext-link":
        url = inner(kids[0])
        d |= {"link": url, "protocol": _protocol(url), "innerText": inner(kids[1]) if len(kids) > 1 else ""}
    elif node.subtype in ("ext-link-url", "free-ext-link", "magic-link"):
        url = inner(node)
        d |= {"link": url, "innerText": url, "protocol": _protocol(url)}
    elif node.type == "PARAMETER":
        d |= {"anon": node.data["anon"], "value": inner(kids[1])}
    elif node.type == "ARG":
        d["default"] = inner(kids[1]) if len(kids) > 1 else None
    elif node.type == "TRANSCLUDE":
        names = [k.name for k in kids if isinstance(k, Node) and k.type == "PARAMETER"]
        d |= {"anonCount": sum(k.data["anon"] for k in kids if isinstance(k, Node) and k.type == "PARAMETER"), "duplication": len(set(names)) < len(names)}
    elif node.type in ("LIST", "DD"):
        m = inner(node)
        d |= {"indent": m.count(":"), "dd": node.type == "DD", "dt": ";" in m, "ul": "*" in m, "ol": "#" in m}
    elif node.type == "CONVERTER":
        d["flags"] = [inner(f).strip() for f in kids[0].children]
    elif node.subtype == "converter-rule":
        d |= {"variant": node.name, "unidirectional": len(kids) == 3, "bidirectional": len(kids) == 2}
    return d


def _protocol(url: str) -> str | None:
    m = re.match(r"([A-Za-z][\w+.-]*:(?://)?|//)", url)
    return m[1].lower() if m else None


def _tree(root: Node, make, child) -> dict:  # noqa: ANN001
    """A nested dict, made from the bottom up without recursion."""
    order: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node))
    made: dict[int, dict] = {}
    for n in reversed(order):
        made[id(n)] = make(n, [child(c) if isinstance(c, str) else made[id(c)] for c in n.children])
    return made[id(root)]


_SKIP = frozenset(("bar", "colon", "open"))


def to_internal(root: Node) -> dict:
    """The full shape: both class names, flags and payload, text children as objects."""

    def make(n: Node, kids: list) -> dict:
        own = {k: v for k, v in n.data.items() if k not in _SKIP and v is not None}
        return {"type": n.subtype, "Type": f"TOKEN_{n.type}", "SubType": n.subtype, **({"name": n.name} if n.name is not None else {}), "extInnerContext": n.in_ext, **own, "childNodes": kids}

    return _tree(root, make, lambda s: {"type": "text", "Type": "TOKEN_TEXT", "text": s})


def to_node(root: Node) -> dict:
    """The short shape: derived fields, text children as strings."""

    source, spans = _source(root, VALUE_ROLES)
    inner = lambda n: source[slice(*spans.get(id(n), (0, 0)))]

    def make(n: Node, kids: list) -> dict:
        own = {k: v for k, v in n.data.items() if k not in _SKIP and v is not None}
        return {"type": n.subtype, **({"name": n.name} if n.name is not None else {}), **own, **_derived(n, inner), "childNodes": kids}

    return _tree(root, make, lambda s: s)
