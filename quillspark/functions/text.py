"""Regular sub-grammars of wikitext as plain Catalyst expressions; no Python per row.

All take a string column; null in gives null out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.kernel.config import SiteConfig, default

# Fixed value: the white space that counts as such in names.
WIDE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def tidy(c: Column) -> Column:
    """Without NUL, DEL, and carriage returns of line ends."""
    return F.regexp_replace(c, "[\\x00\\x7F]|\\r(?=\\n|\\z)", "")


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)<!--.*?(-->|\\z)", "")


def comment_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("(?s)(<!--.*?(?:-->|\\z))"), 1))


def wide_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WIDE}+|{WIDE}+$", "")


def trim_lower(c: Column) -> Column:
    return F.lower(F.trim(c))


def redirect_target(c: Column, config: SiteConfig | None = None) -> Column:
    """Target of a redirect page, null for other pages."""
    words = "|".join(re.escape(x) for x in (config or default()).redirection)
    return F.nullif(F.regexp_extract(c, f"(?i)^\\s*(?:{words})[ \\t]*:?[ \\t]*\\[\\[([^\\n|\\]]+)", 1), F.lit(""))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def headings(c: Column) -> Column:
    """array<struct<level, title>> of the heading lines of plain wikitext."""
    pattern = "^(={1,6})(.*[^=\\s].*?)\\1[ \\t]*$"
    rows = F.filter(lines(c), lambda x: x.rlike(pattern))
    return F.transform(rows, lambda x: F.struct(F.length(F.regexp_extract(x, pattern, 1)).alias("level"), F.trim(F.regexp_extract(x, pattern, 2)).alias("title")))


def rule_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike("^-{4,}")))


def switches(c: Column) -> Column:
    """Behaviour switches, lower-case and without underscores."""
    return F.transform(F.regexp_extract_all(c, F.lit("__([A-Za-z]+)__"), 1), lambda x: F.lower(x))


def list_prefix(line: Column) -> Column:
    return F.regexp_extract(line, "^([*#:;]+)", 1)


def simple_links(c: Column) -> Column:
    """array<struct<target, text>> of links without inner markup; text is null where there is none."""
    whole = F.regexp_extract_all(c, F.lit("(\\[\\[[^\\[\\]{}|\\n]+(?:\\|[^\\[\\]]*)?\\]\\])"), 1)
    one = "^\\[\\[([^|\\]]+)(?:\\|(.*))?\\]\\]$"
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, one, 1).alias("target"), F.when(x.contains("|"), F.regexp_extract(x, one, 2)).alias("text")))


def html_tag_names(c: Column) -> Column:
    """Lower-case names of all tags, closing ones with a slash."""
    return F.transform(F.regexp_extract_all(c, F.lit("<(/?[A-Za-z][\\w-]*)(?:\\s[^<>]*)?/?>"), 1), lambda x: F.lower(x))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("\\b((?:RFC|PMID)[ \\t]+\\d+|ISBN[ \\t]+(?:97[89][ -]?)?(?:\\d[ -]?){9}[\\dXx])\\b"), 1)


def decode_basic_entities(c: Column) -> Column:
    """The common named entities; the ampersand last, so that nothing is decoded twice."""
    for name, to in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.regexp_replace(c, f"(?i)&{name};", to)
    return c


def image_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "\\.([^.]*)$", 1))


def is_image_width(c: Column) -> Column:
    return F.trim(c).rlike("^(?:\\d+x?|\\d*x\\d+)(?:\\s*px)?$")


def url_protocol(c: Column, config: SiteConfig | None = None) -> Column:
    """The protocol a string begins with, longest first; null if none."""
    names = "|".join(re.escape(p) for p in (config or default()).protocols)
    return F.nullif(F.lower(F.regexp_extract(c, f"(?i)^({names})", 1)), F.lit(""))


def title_struct(c: Column, default_ns: int = 0, config: SiteConfig | None = None) -> Column:
    """struct<ns, main, fragment, interwiki, title, valid> of simple titles (no escapes, no relative ones)."""
    config = config or default()
    s = F.trim(F.regexp_replace(c, "[ _\\u00a0]+", " "))
    forced = s.startswith(":")
    s = F.trim(F.regexp_replace(s, "^:", ""))
    prefix = F.lower(F.trim(F.regexp_extract(s, "^([^:#]+):", 1)))
    known = F.create_map(*[F.lit(x) for k, v in config.namespaces.items() for x in (k, v)])
    names = F.create_map(*[F.lit(x) for k, v in config.canonical.items() for x in (k, v)])
    wiki = prefix.isin(*config.interwiki) & ~F.coalesce(known[prefix].isNotNull(), F.lit(False)) if config.interwiki else F.lit(False)
    own = (prefix != "") & known[prefix].isNotNull()
    ns = F.when(own, known[prefix]).when(wiki | forced, F.lit(0)).otherwise(F.lit(default_ns))
    rest = F.when(own | wiki, F.trim(F.regexp_replace(s, "^[^:]+:", ""))).otherwise(s)
    main = F.trim(F.regexp_replace(rest, "#.*$", ""))
    main = F.when(wiki, main).otherwise(F.concat(F.upper(F.substring(main, 1, 1)), F.expr("''"), F.substr(main, F.lit(2))))
    fragment = F.when(rest.contains("#"), F.trim(F.regexp_replace(rest, "^[^#]*#", "")))
    space = names[ns]
    full = F.concat(F.when(wiki, F.concat(prefix, F.lit(":"))).otherwise(""), F.when(space != "", F.concat(space, F.lit(":"))).otherwise(""), main)
    valid = ((main != "") | wiki | (fragment.isNotNull())) & ~main.rlike("[<>\\[\\]{}|\\n]|%[0-9A-Fa-f]{2}|^:|(^|/)\\.\\.?(/|$)")
    return F.struct(ns.alias("ns"), F.translate(main, " ", "_").alias("main"), fragment.alias("fragment"), F.when(wiki, prefix).alias("interwiki"), F.translate(full, " ", "_").alias("title"), valid.alias("valid"))
