"""The parser: round trip, invariants, and trees written by hand from the rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.kernel import config, render
from quillspark.kernel.model import Node
from quillspark.kernel.parse import parse, tidy
from quillspark.kernel.serialize import rows, to_internal, to_node, to_text
from quillspark.kernel.title import parse_title
from quillspark.operators.evaluate import ALLOWED_PARENTS

CFG = config.default()
ZH = config.with_variants("zh-hans", "zh-hant")


def find(root, subtype):
    out, todo = [], [root]
    while todo:
        n = todo.pop(0)
        if n.subtype == subtype:
            out.append(n)
        todo = [c for c in n.children if isinstance(c, Node)] + todo
    return out


def texts(root, subtype):
    return ["".join(c if isinstance(c, str) else to_text(c) for c in n.children) for n in find(root, subtype)]


SAMPLES = [
    "", "plain", "#REDIRECT [[Page of mine]]", " #redirect : [[Foo#bar|baz]] x", "#REDIRECT [[ ]] x", "<!-- a --> <!-- open", "<nowiki>[[a]]</nowiki>", "<ref name=x>a</ref><ref name='y' />", "<ref>open", "<pre>a<nowiki>b</nowiki></pre>",
    "{{a}}", "{{a|b|c=d}}", "{{{a|b|c}}}", "{{{{{a}}}}}", "{{{{a}}}}", "{{a|{{b}}", "{{}}", "{{ }}", "{{a|[[b|c]]}}", "{{#if:x|y=z|w}}", "{{subst:a}}", "{{#invoke:m|f|a=b}}", "{{!}}", "{{a\n|b=c\n}}", "{{[[a]]}}", "{{a|[[b}}", "}}{{",
    "<b>x</b><br/><notag>", '<span class="a" id=b hidden>', "<div {{x}}>", "<meta itemprop=a content=b><meta x>", "{|\n|a\n|}", '{| class="x"\n|+ cap\n! a !! b\n|- id=1\n| x | c || d\n|}', ":{|\n|a\n{|\n|b\n|}\n|}", "{|\n|a", "{{{!}}\n|a\n{{!}}}",
    "== a ==", "== a =", "=a= <!-- x -->", "======= a =======", "===", "----", "-----x", "__TOC__ __x__", "[[a]]", "[[a|b]]", "[[:Category:a]]", "[[Category:a|b]]", "[[File:a.png|thumb|200px|x [[b]] c]]", "[[File:a.png|link=b|alt=c]]", "[[a[b]]", "[[a|b [c]]]", "[[http://x]]", "[[a\nb]]", "[[]]",
    "''a'' '''b''' '''''c'''''", "'''''a'' b'''", "L'''x''", "''''a''''", "''''''''", "[http://a.b c]", "[http://a.b]", "[//a b]", "http://a.b/c(d).", "RFC 1234 PMID 1 ISBN 978-1-234567-89-0", "* a\n** b\n#c\n;d:e\n:f", "-{zh-hans:a;zh-hant:b}-", "-{H|a=>zh-hans:b}-", "-{a}-",
    "<gallery>\nFile:a.png|b\nx[y\n\n</gallery>", "<imagemap>\nFile:a.png|b\nrect 1 2 [[c]]\ndefault [http://x y]\n</imagemap>", "<references><ref name=a>b</ref>\n</references>", "<inputbox>\na=b\n\nc</inputbox>", "<noinclude>a</noinclude><includeonly>b</includeonly>", "a\r\nb\r", "\x00a\x7f", "𝒳 é 中", "<onlyinclude>x</onlyinclude> y",
    "{| a\n|-\n|| b\n| c || d\n | e\n|}", "<poem>\n== a ==\n* b</poem>", "{{a|b=[[c|d]]|{{{e|f}}}}}", "&lt; &#x41;", " [[a]]",
]


@pytest.mark.parametrize("text", SAMPLES)
@pytest.mark.parametrize("include", [False, True])
def test_round_trip(text, include):
    for c in (CFG, ZH):
        for stage in (0, 1, 3, 5, 10):
            assert to_text(parse(text, c, include, max_stage=stage)) == tidy(text)


ALPHABET = st.lists(st.sampled_from(["[[", "]]", "{{", "}}", "{{{", "}}}", "|", "=", "==", "\n", "''", "'''", "{|", "|}", "|-", "!", "!!", "||", "*", ":", ";", "<ref>", "</ref>", "<b>", "<!--", "-->", "-{", "}-", "http://a.b", " ", "a", "File:x.png", "__TOC__", "[", "]", "<nowiki>", "</nowiki>", "----", "{{!}}", "é", ""]), max_size=40).map("".join)


@settings(max_examples=250, deadline=None)
@given(ALPHABET)
def test_random_markup_round_trip_and_invariants(text):
    root = parse(text, ZH)
    assert to_text(root) == tidy(text)
    out = rows(root)
    assert [r[0] for r in out] == list(range(len(out)))
    assert out[0][1] is None and all(r[1] is not None and r[1] < r[0] for r in out[1:])
    by_parent = {}
    for r in out:
        by_parent.setdefault(r[1], []).append(r)
        if r[1] is not None:
            assert r[4] <= out[r[1]][4] and out[r[1]][7] not in ALLOWED_PARENTS.get(None, ())
            need = ALLOWED_PARENTS.get(r[7])
            assert need is None or out[r[1]][7] in need
    assert all([x[2] for x in kids] == list(range(len(kids))) for kids in by_parent.values())
    to_internal(root), to_node(root), render.markdown(root), render.html(root), render.plain_text(root), render.list_items(root)


def test_link_tree():
    root = parse("[[A b|c]]", CFG)
    (link,) = find(root, "link")
    assert link.name == "A_b" and texts(root, "link-target") == ["A b"] and texts(root, "link-text") == ["c"]


def test_templates():
    root = parse("{{Box|x|k=v|{{in|{{{p|d}}}}}}}", CFG)
    assert [t.name for t in find(root, "template")] == ["Template:Box", "Template:In"]
    assert [p.name for p in find(root, "parameter")] == ["1", "k", "2", "1"]
    assert [a.name for a in find(root, "arg")] == ["p"]
    assert not find(parse("{{a<b}}", CFG), "template") and not find(parse("{{#nope:x}}", CFG), "template")


def test_brace_runs():
    assert [n.subtype for n in parse("{{{a}}}", CFG).children] == ["arg"]
    five = parse("{{{{{a}}}}}", CFG)
    assert [n.subtype for n in five.children] == ["template"] and find(five, "arg")
    assert parse("{{{{a}}}}", CFG).children[0] == "{"


def test_stages():
    text = "{{a}} <b> [[c]] ''d''"
    kinds = lambda s: {n.type for n in parse(text, CFG, max_stage=s).children if isinstance(n, Node)}
    assert kinds(0) == set() and kinds(1) == {"TRANSCLUDE"} and kinds(2) == {"TRANSCLUDE", "HTML"} and kinds(10) == {"TRANSCLUDE", "HTML", "LINK", "QUOTE"}


def test_table():
    root = parse('{| class="t"\n|+ cap\n! a !! b\n|-\n| id=x | c || d\n|}\nend', CFG)
    assert [c.name for c in find(root, "td")] == ["caption", "th", "th", "td", "td"]
    assert [t.strip() for t in texts(root, "td-inner")] == ["cap", "a", "b", "c", "d"]
    assert len(find(root, "tr")) == 1 and root.children[-1] == "\nend"


def test_headings_and_rules():
    root = parse("== a ==\n=== b == \n----x\n---\n__NOTOC__", CFG)
    assert [(h.data["level"], t.strip()) for h, t in zip(find(root, "heading"), texts(root, "heading-title"), strict=True)] == [(2, "a"), (2, "= b")]
    assert texts(root, "hr") == ["----"] and [f.name for f in find(root, "double-underscore")] == ["notoc"]


def test_files_and_categories():
    root = parse("[[File:a.png|thumb|20px|alt=x|cap [[b]]]] [[Category:C|k]] [[:File:a.png]]", CFG)
    assert [p.name for p in find(root, "image-parameter")] == ["thumbnail", "width", "alt", "caption"]
    assert find(root, "file")[0].name == "File:A.png" and find(root, "category")[0].name == "Category:C" and len(find(root, "link")) == 2


def test_quotes():
    q = lambda s: [(n.data["bold"], n.data["italic"]) for n in find(parse(s, CFG), "quote")]
    assert q("'''a''' ''b''") == [(True, False)] * 2 + [(False, True)] * 2
    assert q("L'''x''") == [(False, True)] * 2
    assert q("''''a''''") == [(True, False)] * 2


def test_external_and_magic_links():
    root = parse("[https://a.b c] https://d.e/f. RFC 12 PMID 3 ISBN 0-123456-78-9", CFG)
    assert texts(root, "ext-link-url") == ["https://a.b"] and texts(root, "free-ext-link") == ["https://d.e/f"]
    assert [n.name for n in find(root, "magic-link")] == ["RFC", "PMID", "ISBN"]


def test_lists_and_definitions():
    root = parse("* a\n*# b\n; t : d\n: e", CFG)
    assert texts(root, "list") == ["*", "*#", ";"] and texts(root, "dd") == [":", ":"]
    assert [x[1:] for x in render.list_items(root)] == [("*", 1, False, "a", None), ("*#", 2, True, "b", None), (";", 1, False, "t", "d"), (":", 1, False, "e", None)]


def test_variants():
    root = parse("-{A;T|a=>zh-hans:b;zh-hant:c}-", ZH)
    assert texts(root, "converter-flag") == ["A", "T"] and texts(root, "converter-rule-from") == ["a"] and texts(root, "converter-rule-to") == ["b", "c"]
    assert not find(parse("-{a}-", CFG), "converter")


def test_include_modes():
    text = "a<noinclude>b</noinclude><includeonly>c</includeonly>"
    assert texts(parse(text, CFG), "include") == ["c"] and texts(parse(text, CFG, include=True), "include") == ["b"]
    only = parse("a<onlyinclude>b</onlyinclude>c", CFG, include=True)
    assert texts(only, "onlyinclude") == ["b"] and texts(only, "noinclude") == ["a", "c"]


def test_payloads_that_are_easily_left_empty():
    root = parse("#REDIRECT [[a|b]]<ref name=x>y</ref><includeonly>z</includeonly>", CFG)
    r, e, i = find(root, "redirect")[0], find(root, "ext")[0], find(root, "include")[0]
    assert r.data["display"] == "b" and e.data["ext_attr"] == " name=x" and e.data["ext_inner"] == "y" and i.data["tag"] == "includeonly" and i.data["inner"] == "z"


def test_no_depth_is_cut_off():
    for n in (20, 500):
        assert len(find(parse("{{a|" * n + "[[L]]" + "}}" * n, CFG), "link")) == 1
        root = parse("{|\n|\n" * n + "[[L]] ''q''" + "\n|}" * n, CFG)
        assert len(find(root, "link")) == 1 and len(find(root, "quote")) == 2
        assert "[L](/wiki/L) *q*" in render.markdown(root) and "<a" in render.html(root)


@pytest.mark.parametrize("text", ["[[File:a.png|" * 4000 + "]]" * 4000, "[[a|" * 4000 + "]]" * 4000, "[[" * 8000, "{{a|" * 4000 + "}}" * 4000])
def test_time_grows_with_the_text(text):
    import time

    began = time.perf_counter()
    root = parse(text, CFG)
    assert len(rows(root)) > 0 and to_text(root) == text and time.perf_counter() - began < 5


def test_links_pair_up_once():
    assert texts(parse("[[a|b [[c]] d]]", CFG), "link-target") == ["c"] and texts(parse("[[a|[x]]] [[b]]]", CFG), "link-text") == ["[x]"]
    nested = parse("[[File:a.png|[[File:b.png|[[c]]]] d]]", CFG)
    assert len(find(nested, "file")) == 2 and len(find(nested, "link")) == 1


def test_image_parameters_stand_around_markup():
    root = parse("<gallery>\nFile:A.png|[[b|c]] d\nFile:B.png|{{t|x}} d|alt=e\n</gallery>[[File:C.png|see [http://a.b/c|d e]]]", CFG)
    assert texts(root, "image-parameter") == ["[[b|c]] d", "{{t|x}} d", "e", "see [http://a.b/c|d e]"]
    assert len(find(root, "link")) == 1 and len(find(root, "template")) == 1 and texts(root, "ext-link-url") == ["http://a.b/c|d"]
    named = lambda s: [p.name for p in find(parse(s, CFG), "image-parameter")]
    assert named("[[File:a.png|lang=de|page=2|upright=x|link=a<b]]") == ["caption"] * 4 and named("[[File:a.svg|lang=de|upright=2|link=b]]") == ["lang", "upright", "link"]


def test_magic_links_and_hosts():
    assert texts(parse("rfc 1 RFC&nbsp;14 xRFC 2", CFG), "magic-link") == ["RFC&nbsp;14"]
    root = parse("[http://[::1]/ x] [{{fullurl:a}} y] http://[::1]/z", CFG)
    assert texts(root, "ext-link-url") == ["http://[::1]/", "{{fullurl:a}}"] and texts(root, "free-ext-link") == ["http://[::1]/z"]


def test_headings_of_many_signs():
    assert [h.data["level"] for h in find(parse("======= q =======\n=== a ==", CFG), "heading")] == [6, 2]
    assert texts(parse("======= q =======\n=== a ==", CFG), "heading-title") == ["= q =", "= a "]


def test_attribute_values_with_markup():
    root = parse('<gallery caption="[[a]]"></gallery><ref details="{{b}}">c</ref><span title="-{d}-" id="[[e]]">', ZH)
    assert texts(root, "link-target") == ["a"] and texts(root, "template-name") == ["b"] and len(find(root, "converter")) == 1


def test_definitions():
    assert texts(parse(";;a:b:c:d", CFG), "dd") == [":", ":"] and texts(parse("; ''a:b'':c", CFG), "dd") == [":"] and texts(parse("; <b>a:b</b>", CFG), "dd") == []


def test_list_marks_part_in_front_of_terms():
    marks = lambda s: [texts(parse(line, CFG), "list") for line in [s]][0]
    assert marks(";;a") == [";", ";"] and marks("*;#a") == ["*", ";#"] and marks("*;#a\n*;#b") == ["*", ";#", "*;#"]
    assert [x[1] for x in render.list_items(parse("*;#a\n*;b : c", CFG))] == ["*;#", "*;"] and render.list_items(parse(";a : b", CFG))[0][4:] == ("a", "b")


def test_comments_around_the_sign_of_a_table_attribute():
    root = parse("{| class <!-- c --> = 'x' id{{=}}y\n|}", CFG)
    assert texts(root, "attr-key") == ["class", "id"] and texts(root, "attr-value") == ["x", "y"] and to_text(root) == "{| class <!-- c --> = 'x' id{{=}}y\n|}"


def test_translate_beside_nowiki():
    c = config.from_dict(config._DEFAULT | {"ext": [*config._DEFAULT["ext"], "translate"]})
    assert texts(parse("<translate>a<nowiki></translate></nowiki>b</translate>c", c), "translate") == ["a<nowiki></translate></nowiki>b"]
    assert not find(parse("<translate>a", c), "translate")


def test_values_are_the_texts_of_the_contents():
    for text in (*SAMPLES, "#REDIRECT [[A|b]] [[C|d]] {{e|f=g}}"):
        root = parse(text, ZH)
        nodes, todo = [], [root]
        while todo:
            x = todo.pop()
            nodes.append(x)
            todo.extend(reversed(x.children) if isinstance(x, Node) else ())
        for x, r in zip(nodes, rows(root), strict=True):
            if r[11] is not None and not x.sep:
                assert r[11] == "".join(c if isinstance(c, str) else to_text(c) for c in x.children), text


def test_rows_of_some_columns():
    root = parse("== a ==\n[[b]]<ref name=x>y</ref><ref name=x />", CFG)
    assert rows(root, ("subtype", "value")) == [(r[7], r[11]) for r in rows(root)]
    payloads = {r[7]: r[15] for r in rows(root) if r[7] in ("heading", "ext")}
    assert payloads["heading"]["ordinal"] == 1 and payloads["ext"]["number"] == 1 and payloads["ext"]["ref_name"] == "x"


def test_deep_nesting_does_not_fail():
    text = "{{a|" * 3000 + "}}" * 3000
    assert to_text(parse(text, CFG)) == text
    assert len(rows(parse("<div>" * 5000, CFG))) > 5000


@pytest.mark.parametrize(
    ("raw", "ns", "title", "valid"),
    [("foo bar", 0, "Foo_bar", True), (" talk : x_y ", 1, "Talk:X_y", True), (":Category:a", 14, "Category:A", True), ("a#b", 0, "A", True), ("#b", 0, "", True), ("w:x", 0, "w:x", True), ("a<b", 0, "A<b", False), ("%41b", 0, "Ab", True), ("a%2525", 0, "A%25", False), ("../x", 0, "../x", False), ("&amp;a", 0, "&a", True), ("ßa", 0, "SSa", True)],
)
def test_titles(raw, ns, title, valid):
    t = parse_title(raw, CFG)
    assert (t.ns, t.title, t.valid) == (ns, title, valid)


def test_relative_titles():
    assert parse_title("/sub", CFG, page="Main").title == "Main/sub" and parse_title("../b", CFG, page="A/c").title == "A/b"


def test_config_from_json():
    c = config.from_string('{"protocol": "https?://|ftp://", "namespaces": {"0": "", "6": "File"}, "nsid": {"bild": 6}, "ext": ["translate"], "doubleUnderscore": [[], [], {"toc": "toc"}, {}]}')
    assert c.protocols == ("https://", "http://", "ftp://") and c.namespaces["bild"] == 6 and "translationlanguage" in c.variables and "toc" in c.switches_ci
    with pytest.raises(ValueError):
        config.from_string("{}")
    assert c.version != CFG.version


def test_markdown():
    md = lambda s: render.markdown(parse(s, CFG))
    assert md("== a ==\n'''b''' ''c''") == "## a\n**b** *c*"
    assert md("[[a|b]] [http://x y]") == "[b](/wiki/A) [y](http://x)"
    assert md("{|\n! a\n|-\n| b\n|}") == "| a |\n| --- |\n| b |"
    assert md('x<ref name="n">note</ref>y<ref name="n" />') == "x[^n]y[^n]\n\n[^n]: note"
    assert md("* a\n** b") == "- a\n  - b".replace("- a", "-  a").replace("- b", "-  b")


def test_scan_modes():
    from quillspark.kernel.scan import RULES, fixpoint, scan

    inner = lambda s, r: [s[x.inner_start : x.inner_end] for x in scan(s, RULES[r]) if x.kind == "inner"]
    assert inner("{{a{{b}}c}} {{d}}", "template_inner") == ["b", "d"] and inner("{{a{{b}}c}} {{d}}", "template_outer") == ["a{{b}}c", "d"]
    assert inner("<!-- a <!-- b --> c -->", "comment") == [" a <!-- b "] and inner("{{{{a}}}}", "argument") == []
    assert [x.kind for x in scan("a<nowiki/>b<NOWIKI>c</nowiki>", RULES["nowiki"])] == ["text", "self_closing", "text", "inner"]
    assert inner("[[a\nb]] [[c]]", "wikilink") == ["c"] and inner("__TOC__ __a b__", "switch") == ["TOC"]
    assert fixpoint("{{{a}}} {{{b|{{{c}}} }}}", RULES["argument"], lambda x: f"<{x}>").count("<") >= 2
    for s in ("", "x", "{{a", "}}", "{{a}}{{b"):
        assert "".join(s[x.start : x.end] for x in scan(s, RULES["template_inner"])) == s


def test_single_text_api():
    from quillspark.kernel.api import WikiConfig, WikiParser

    p = WikiParser()
    assert p.parse_to_string("") == "" and p.parse_to_dict("") == {} and p.parse("") is None
    assert p.parse_to_string("[[a]]\r\n") == "[[a]]\n" and p.parse_to_dict("[[a]]")["childNodes"][0]["type"] == "link"
    assert WikiParser(WikiConfig.from_string('{"protocol": "x:"}')).parse("''a''").children
