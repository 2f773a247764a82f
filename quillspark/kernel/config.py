"""Site grammar: which tags, namespaces, protocols, words and image options a wiki has."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from functools import cached_property
from itertools import product
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class SiteConfig:
    """A frozen grammar; build it with ``load`` or ``from_dict``, both of which derive and check what the grammar needs."""

    ext: tuple[str, ...]
    html: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]
    namespaces: dict[str, int]
    canonical: dict[int, str]
    redirection: tuple[str, ...]
    switches_ci: dict[str, str]
    switches_cs: dict[str, str]
    protocols: tuple[str, ...]
    variants: tuple[str, ...] = ()
    variables: frozenset[str] = frozenset()
    functions_ci: dict[str, str] = field(default_factory=dict)
    functions_cs: dict[str, str] = field(default_factory=dict)
    modifiers_raw: tuple[str, ...] = ()
    modifiers_subst: tuple[str, ...] = ()
    interwiki: tuple[str, ...] = ()
    img: dict[str, str] = field(default_factory=dict)
    excludes: frozenset[str] = frozenset()

    @cached_property
    def version(self) -> str:
        """Hash of the grammar, for reproducible results."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else list(x)).encode()).hexdigest()[:12]

    @cached_property
    def protocol_re(self) -> str:
        return "|".join(re.escape(p) for p in self.protocols)

    @cached_property
    def html_names(self) -> frozenset[str]:
        return frozenset(n for group in self.html for n in group)

    @cached_property
    def html_void(self) -> frozenset[str]:
        """Tags that are never closed: the third group."""
        return frozenset(self.html[2]) if len(self.html) > 2 else frozenset()


def expand_protocols(fragment: str) -> tuple[str, ...]:
    """``a?b|c`` to all variants of optional characters, longest first."""
    out: set[str] = set()
    for alt in fragment.split("|"):
        parts = re.findall(r"(.)(\??)", alt.replace("\\", ""))
        if sum(bool(q) for _, q in parts) > 8:
            raise ValueError("too many optional characters in a protocol")
        for pick in product(*[(c, "") if q else (c,) for c, q in parts]):
            if s := "".join(pick):
                out.add(s)
    return tuple(sorted(out, key=lambda s: (-len(s), s)))


def from_dict(raw: dict[str, Any]) -> SiteConfig:
    """A grammar from the JSON keys of a site configuration; ``protocol`` is required."""
    if not raw.get("protocol"):
        raise ValueError("a configuration needs a protocol")
    spaces: dict[str, int] = {}
    canonical: dict[int, str] = {}
    for k, v in (raw.get("namespaces") or {}).items():
        name, num = (v, int(k)) if re.fullmatch(r"-?\d+", str(k)) else (k, int(v))
        spaces[str(name).lower().replace("_", " ")] = num
        canonical.setdefault(num, str(name).replace("_", " "))
    for k, v in (raw.get("nsid") or {}).items():
        spaces.setdefault(str(k).lower().replace("_", " "), int(v))
    dunder = list(raw.get("doubleUnderscore") or [[], [], {}, {}])
    dunder += [[], [], {}, {}][len(dunder) :]
    ci, cs = dict(dunder[2] or {}), dict(dunder[3] or {})
    ci |= {x: x for x in dunder[0] if x.lower() not in {k.lower() for k in ci}}
    cs |= {x: x for x in dunder[1] if x not in cs}
    pf = list(raw.get("parserFunction") or [{}, {}, [], []])
    pf += [{}, {}, [], []][len(pf) :]
    variables, functions_cs = set(raw.get("variable") or ()), dict(pf[1])
    if "translate" in (raw.get("ext") or ()):
        variables.add("translationlanguage")
        functions_cs.setdefault("TRANSLATIONLANGUAGE", "translationlanguage")
    html = raw.get("html") or [[], [], []]
    return SiteConfig(
        ext=tuple(x.lower() for x in raw.get("ext") or ()), html=tuple(tuple(g) for g in html), namespaces=spaces, canonical=canonical,
        redirection=tuple(raw.get("redirection") or ("#redirect",)), switches_ci={k.lower(): v for k, v in ci.items()}, switches_cs=cs,
        protocols=expand_protocols(raw["protocol"]), variants=tuple(raw.get("variants") or ()), variables=frozenset(variables),
        functions_ci={k.lower(): v for k, v in dict(pf[0]).items()}, functions_cs=functions_cs, modifiers_raw=tuple(x.lower() for x in pf[2]), modifiers_subst=tuple(x.lower() for x in pf[3]),
        interwiki=tuple(x.lower() for x in raw.get("interwiki") or ()), img=dict(raw.get("img") or {}), excludes=frozenset(raw.get("excludes") or ()),
    )


def from_string(s: str) -> SiteConfig:
    return from_dict(json.loads(s))


def load(path: str | Path) -> SiteConfig:
    return from_string(Path(path).read_text("utf-8"))


# A small public grammar, after the documentation of the markup.
_DEFAULT: dict[str, Any] = {
    "ext": "nowiki pre gallery indicator langconvert ref references math chem ce syntaxhighlight source poem imagemap inputbox score templatedata timeline hiero section templatestyles charinsert categorytree dynamicpagelist mapframe maplink graph".split(),
    "html": [
        "abbr b bdi bdo big blockquote center cite code data del dfn div em font h1 h2 h3 h4 h5 h6 i ins kbd mark p q rb rp rt rtc ruby s samp small span strike strong sub sup table time tt u var caption dl ol ul".split(),
        "dd dt li td th tr".split(),
        "br hr wbr img meta link".split(),
    ],
    "namespaces": {"-2": "Media", "-1": "Special", "0": "", "1": "Talk", "2": "User", "3": "User talk", "4": "Project", "5": "Project talk", "6": "File", "7": "File talk", "8": "MediaWiki", "9": "MediaWiki talk", "10": "Template", "11": "Template talk", "12": "Help", "13": "Help talk", "14": "Category", "15": "Category talk", "828": "Module", "829": "Module talk"},
    "nsid": {"image": 6, "image talk": 7, "wp": 4, "t": 10},
    "redirection": ["#redirect"],
    "doubleUnderscore": [[], [], {x: x for x in "notoc nogallery forcetoc toc noeditsection archivedtalk notalk hiddencat expectunusedcategory index noindex staticredirect newsectionlink nonewsectionlink disambig noglobal".split()}, {x: x.lower() for x in "NOTITLECONVERT NOTC NOCONTENTCONVERT NOCC".split()}],
    "protocol": "bitcoin:|ftps?://|git://|gopher://|https?://|ircs?://|magnet:|mailto:|mms://|news:|nntp://|redis://|sftp://|sips?:|sms:|ssh://|svn://|tel:|telnet://|urn:|worldwind://|xmpp:|//",
    "variable": "! = !! (! !) !- pagename pagenamee fullpagename basepagename subpagename namespace talkpagename currentyear currentmonth currentday currenttime currenttimestamp sitename server servername scriptpath numberofpages numberofarticles revisionid revisionuser".split(),
    "parserFunction": [
        {x: x for x in "#if #ifeq #ifexist #ifexpr #iferror #switch #expr #time #rel2abs #titleparts #invoke #tag #property #statements #language #special ns nse urlencode lcfirst ucfirst lc uc localurl localurle fullurl fullurle canonicalurl canonicalurle filepath formatnum grammar gender plural bidi padleft padright anchorencode int".split()},
        {x: x.lower() for x in "DEFAULTSORT DISPLAYTITLE PAGESINCATEGORY PAGENAME FULLPAGENAME NAMESPACE TALKPAGENAME".split()},
        ["msg", "raw", "msgnw"],
        ["subst", "safesubst"],
    ],
    "interwiki": "commons wikt wiktionary wikipedia w meta mw d wikidata species b n q s v voy de fr es".split(),
    "img": {
        "thumb": "thumbnail", "thumbnail": "thumbnail", "thumb=$1": "manualthumb", "thumbnail=$1": "manualthumb", "frame": "framed", "framed": "framed", "enframed": "framed", "frameless": "frameless", "upright": "upright", "upright=$1": "upright", "upright $1": "upright",
        "border": "border", "left": "left", "right": "right", "center": "center", "centre": "center", "none": "none", "baseline": "baseline", "sub": "sub", "super": "super", "sup": "super", "top": "top", "text-top": "text-top", "middle": "middle", "bottom": "bottom", "text-bottom": "text-bottom",
        "alt=$1": "alt", "link=$1": "link", "class=$1": "class", "lang=$1": "lang", "page=$1": "page", "page $1": "page", "$1px": "width",
    },
}


def default() -> SiteConfig:
    return from_dict(_DEFAULT)


def with_variants(*names: str) -> SiteConfig:
    """The default grammar of a wiki with language variants."""
    return from_dict(_DEFAULT | {"variants": list(names)})
