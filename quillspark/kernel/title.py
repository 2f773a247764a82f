"""Page titles: parts, validity and normal form."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

from quillspark.kernel.config import SiteConfig

# Fixed value: the white space that counts as such in titles and names.
WIDE_SPACE = " \t\n\x0b\x0c\r\xa0                　﻿"
_BAD = re.compile(r"[<>\[\]{}|\n\x00-\x1f\x7f-]|%[0-9A-Fa-f]{2}")
_GAP = re.compile("[ _\xa0 ᠎ -     　]+")
_ENTITY = re.compile(r"&(?:#[xX][0-9A-Fa-f]{1,6}|#\d{1,7}|[A-Za-z]{2,8});")
# The entities that titles decode.
_BASIC = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " ", "lbrack": "[", "rbrack": "]", "lbrace": "{", "rbrace": "}", "verbar": "|", "num": "#", "colon": ":", "equals": "="}


def decode_entities(s: str) -> str:
    """Numeric entities and the basic named ones, which go by any case; others stay."""

    def one(m: re.Match[str]) -> str:
        e = m[0][1:-1]
        if e[0] == "#":
            n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
            return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]
        return _BASIC.get(e.lower(), m[0])

    return _ENTITY.sub(one, s) if "&" in s else s


def decode_percent(s: str) -> str:
    """Percent escapes of valid UTF-8; malformed ones and plus signs stay."""
    if "%" not in s:
        return s
    try:
        return re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: unquote_to_bytes(m[0]).decode("utf-8"), s)
    except UnicodeDecodeError:
        return s


@dataclass(frozen=True)
class Title:
    main: str
    ns: int
    prefix: str
    fragment: str | None
    interwiki: str
    title: str
    valid: bool


def first_upper(s: str) -> str:
    c = s[:1]
    up = "SS" if c == "ß" else c.upper()
    return (up if c and (len(up) == 1 or c == "ß") else c) + s[1:]


def relative(target: str, page: str | None) -> str:
    """``/sub`` and ``../`` seen from a page."""
    if not page:
        return target
    if target.startswith("/"):
        return page + target.rstrip("/") if target.rstrip("/") else target
    up = 0
    rest = target
    while rest == ".." or rest.startswith("../"):
        up, rest = up + 1, rest[3:]
    if up:
        parts = page.split("/")
        if up >= len(parts):
            return target
        return "/".join(parts[:-up] + ([rest.rstrip("/")] if rest.rstrip("/") else []))
    return target


def parse_title(raw: str, config: SiteConfig, default_ns: int = 0, page: str | None = None) -> Title:
    s = decode_entities(decode_percent(raw)).strip(WIDE_SPACE)
    s = _GAP.sub(" ", s).strip()
    own = s.startswith("#")
    s = relative(s, page) if default_ns == 0 or s.startswith(("/", "../")) else s
    ns, prefix, interwiki = default_ns, "", ""
    if s.startswith(":"):
        ns, s = 0, s[1:].lstrip()
    m = re.match(r"([^:#]+?)\s*:\s*", s)
    if m and m[1].lower() in config.interwiki and m[1].lower() not in config.namespaces:
        interwiki, s, ns = m[1].lower(), s[m.end() :], 0
    else:
        m = re.match(r"([^:#]+?)\s*:\s*", s)
        if m and m[1].lower() in config.namespaces:
            ns, s = config.namespaces[m[1].lower()], s[m.end() :]
    main, sep, fragment = s.partition("#")
    main = main.strip()
    frag = fragment.strip() if sep else None
    if main and not interwiki:
        main = first_upper(main)
    name = config.canonical.get(ns, "")
    prefix = f"{name}:" if name else ""
    again = decode_entities(decode_percent(main))
    parts = main.split("/")
    valid = (
        bool(main or interwiki or (own and sep))
        and again == main
        and not main.startswith(":")
        and not _BAD.search(main)
        and not any(p in (".", "..") for p in parts)
        and len(main.encode()) <= 255
    )
    full = (f"{interwiki}:" if interwiki else "") + prefix + main
    return Title(main.replace(" ", "_"), ns, prefix, frag, interwiki, full.replace(" ", "_"), valid)


def normalize(raw: str) -> str:
    """A plain normal form where a title need not be valid: blanks to single underscores, first letter up."""
    return first_upper(_GAP.sub("_", html.unescape(raw).strip(WIDE_SPACE)).strip("_"))
