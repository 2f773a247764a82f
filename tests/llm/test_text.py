"""The text functions on hand-made cases, and properties of splitting and packing."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import abuse, markup, mix, pack, quality
from quillspark.llm import split as sp


def kinds(t):
    return set(markup.analyse(t).kinds)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<b>x</b>", {"html"}), ("a<br/>b", {"html"}), ("a <!-- b --> c", {"html"}), ("x &amp; y", {"html"}), ("&#8211;", {"html"}), ("<ref name=\"a\" />", {"html"}),
        ("## Title", {"markdown"}), ("a **b** c", {"markdown"}), ("a *b* c", {"markdown"}), ("`x`", {"markdown"}), ("```\nx\n```", {"markdown"}), ("[a](b.md)", {"markdown"}), ("![a](b.png)", {"markdown"}), ("|a|b|\n|---|:-:|\n|c|d|", {"markdown"}),
        ("[[a|b]]", {"wiki"}), ("[[Category:A]]", {"wiki"}), ("{{a|b}}", {"wiki"}), ("{{{1|x}}}", {"wiki"}), ("''a''", {"wiki"}), ("== a ==", {"wiki"}), ("{|\n|-\n| a\n|}", {"wiki"}), ("[https://a.b c]", {"wiki"}), ("__NOTOC__", {"wiki"}), ("x ~~~~", {"wiki"}),
        ("\\textbf{a}", {"latex"}), ("\\begin{x}\na\n\\end{x}", {"latex"}), ("$x_1 + y$", {"latex"}), ("\\(a\\)", {"latex"}), ("\\[ a \\]", {"latex"}), ("$$ a = b $$", {"latex"}),
        ("It costs $5 or $12 in all.", set()), ("x == y and a != b", set()), ("for (i = 0; i < n; i++) s += a[i];", set()), ("[[1, 2], [3, 4]]", set()), ("~/wiki/5 and --stage=3", set()), ("* a\n* b\n# c\n# d", set()), ("i < n and n > 2", set()), ("#3 of 24", set()), ("50% | 60%", set()),
        ("my_field_name __init__ C:\\temp\\new", set()), ("2 * 3 * 4", set()), ("he wrote <3", set()), ("[sic]", set()), ("", set()), ("   ", set()), (None, set()),
    ],
)
def test_markup_kinds(text, want):
    assert kinds(text) == want
    assert kinds(text and text.replace("\n", "\r\n")) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$$ [[Ab]] = n^2 + 1 $$", {"latex", "wiki"}), ("$$ s = **n^2** + 2 $$", {"latex", "markdown"}), ("$x_1 + &amp; y$", {"latex", "html"}), ("<!-- check {{a b}} c -->", {"html", "wiki"}), ("`{{a}}`", {"markdown", "wiki"}), ("``a <br/> b``", {"markdown", "html"}),
        ("![a <b>c</b>](d.png)", {"markdown", "html"}), ("{{a <br/>|b}}", {"wiki", "html"}), ("[[a **b** c|d]]", {"wiki", "markdown"}), ('<i title="{{a}}">', {"html", "wiki"}), ("{{{&amp;|b}}}", {"wiki", "html"}),
        ("**" + "a " * 900 + "b**", {"markdown"}), ("*" + "a " * 900 + "b*", {"markdown"}), ("$x_1 " + "+ y " * 900 + "z$", {"latex"}), ("$$ x " + "+ y\n" * 900 + "z $$", {"latex"}),
        ("$f''(x) = g''(x)$", {"latex"}), ("$A^*B^* = e^{{x}}$", {"latex"}), ("$$ <x> = f[a](y) ~~~ z $$", {"latex"}), ("`a[[i]]` and `it''s` and `Map<Foo>` and `[[ -f x ]]`", {"markdown"}),
    ],
)
def test_markup_inside_other_markup(text, want):
    assert kinds(text) == want


def test_lexing_long_runs_is_linear():
    for t in ("**a " * 100_000, "**a " * 100_000 + "b**", "<!-- a " * 50_000, "<!-- a " * 50_000 + "-->", "$$ a_1 " * 50_000, "$a " * 100_000, "{{a " * 50_000, "`a " * 100_001):
        began = time.process_time()
        markup.analyse(t)
        assert time.process_time() - began < 20


def test_content_region():
    page = '<div><a href="x">y</a></div><ul><li></li></ul>' + "The rain fell for many days and the fields were wet. " * 3 + "</div></div><br/><br/>"
    a, b, score = markup.analyse(page).region
    assert page[a:b].startswith("The rain") and page[a:b].endswith("wet") and score > 0
    assert markup.best_region([(-1.0, 0, 1), (2.0, 1, 2), (-1.0, 2, 3), (2.0, 3, 4), (-3.0, 4, 5)]) == (1, 4, 3.0)
    assert markup.best_region([(-1.0, 0, 1)]) is None


def test_markup_segments():
    text = "The rain fell for many days. [[a]] [[b]] [[c]] and the fields were wet. ''d''"
    start, end, score = markup.analyse(text).kinds["wiki"]
    assert text[start:end].startswith("[[a]] [[b]] [[c") and score > 0
    w = markup.weights()
    assert w["word"] > 0 and all(w[k] < 0 for k in markup.KINDS)
    odd = markup.weights(("⟦a b⟧ <br/> <br/>",))
    assert odd["html"] < odd["wiki"] and odd["word"] > 0


def test_clean_keeps_structure():
    assert markup.clean("== A ==\n* [[b|c]] ''d'' {{e|f}}\n$x^2$ `y`<ref>n</ref>") == "## A\n* c d f\n$x^2$ `y`[^1]\n\n[^1]: n"
    assert markup.clean("<h2>T</h2><ul><li>a</li><li>b</li></ul>") == "## T\n\n- a\n- b"
    assert markup.clean("\\section{A}\n\\textbf{b} \\item c") == "# A\n\nb \n- c"
    assert markup.clean("<pre>\na b\n</pre>") == "```\na b\n```" and markup.clean(None) is None and markup.clean("") == ""


def test_clean_leaves_code_and_formulas_alone():
    fence = "```py\nf(a, **kw)  # {{x}} [[d|e]] <T> a || b\n```"
    assert markup.clean(f"Some words first.\n{fence}\n''more'' words") == f"Some words first.\n{fence}\nmore words"
    formula = "$$ " + "x_1 + [[y]] " * 900 + "$$"
    assert len(formula) > 10_000 and markup.clean(f"We see that {formula} holds for **all** n") == f"We see that {formula} holds for all n"
    assert markup.clean("\\begin{align}a & b \\\\ \\textbf{c}\\end{align} then \\textbf{d}") == "\\begin{align}a & b \\\\ \\textbf{c}\\end{align} then d"
    assert markup.clean('<syntaxhighlight lang="c">\nx = [[1]];\n</syntaxhighlight>') == "```c\nx = [[1]];\n```"
    assert markup.clean("a || b!! It is so!!!") == "a || b!! It is so!!!" and markup.clean("**" + "a " * 900 + "b**") == "a " * 900 + "b"


def test_clean_drops_what_lies_outside_the_region():
    bar = '<div class="nav"><a href="/">Home</a> <a href="/x">More</a></div>'
    prose = "The rain fell for nine days, and the lower fields stood under water until the dikes were opened."
    foot = '<div><a href="/i">Imprint</a></div>'
    assert markup.clean(f"{bar}<p>{prose}</p>{foot}") == prose
    page = f"{bar}\n<h2>Weather</h2>\n<p>{prose}</p>\n<ul><li>one</li></ul>\n<pre>x = 1</pre>\n{foot}"
    assert markup.clean(page) == f"## Weather\n\n{prose}\n\n- one\n\n```\nx = 1\n```"


def test_clean_tables():
    assert markup.clean('{| class="x"\n! a !! b\n|-\n| style="y" | c || [[d|e]]\n|}') == "| a | b |\n| --- | --- |\n| c | e |"
    rows = "| a | b |\n|---|---|\n| c | d |"
    assert markup.clean(rows) == rows


def test_cleaning_long_runs_is_linear():
    for t in ("**a " * 50_000, "''a " * 50_000, "<!-- a " * 30_000, "{{a|" * 30_000, "<ref>" * 30_000, "<pre>" * 30_000, "[[a " * 50_000, "\\begin{align}" * 30_000, "{|\n" * 30_000, "```\n" * 20_001, "<p>" * 50_000):
        began = time.process_time()
        markup.clean(t)
        assert time.process_time() - began < 20, t[:20]


PROSE = "The river passes the town from the north and turns near the old bridge. It was built in the same year as the school."


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (PROSE, "prose"), (PROSE.replace(" turns", "\nturns"), "prose"), ("- a b\n- c d\n- e", "list"), ("1. apple\n2. pear\n3. plum", "list"), ("apple pie\npear tart\nplum cake\nfig", "list"), ("apple, pear, plum, fig, grape, melon, lime, peach", "list"),
        ("a\tb\tc\n1\t2\t3\n4\t5\t6", "table"), ("a;b;c\n1;2;3\n4;5;6", "table"), ("a,b,c\n1,2,3\n4,5,6", "table"), ("| a | b |\n|---|---|\n| c | d |", "table"), ("{|\n! a !! b\n|-\n| c || d\n|}", "table"), ("<table>\n<tr><td>a</td><td>b</td></tr>\n</table>", "table"), ("a     b     c\nd     e     f\ng     h     i", "table"),
        ("@/?,! ^ ^,+^ .?; ;,,.:!? //", "junk"), ("q w e r t y u i o p a s d", "junk"), ("IGUsG7t5nGCtI6pDz/V+5I/idI0sAc1J+KA9geU+vxluJUkKMHpaG72TgB", "junk"), ("66/ 14 3 2402200: 722752? 895 73/ 790899:", "junk"), ("ferry ferry ferry ferry ferry ferry ferry ferry ferry ferry", "junk"), ("0b621d 9d 16 4c 8c f3 48 20\n04b557 ad 1e 89 2d d2", "junk"),
        (f"{PROSE}\n{PROSE}\n- a\n- b", "prose"), ("", None), (" \n ", None), (None, None),
    ],
)
def test_forms(text, form):
    assert quality.document_form(text) == form


@pytest.mark.parametrize(("name", "ok"), [("Infobox settlement", True), ("Category:Ossby", True), ("Inkbeetle77", True), ("1984", True), ("PAGENAME", True), ("d75c4d234367a1", False), ("vS64p4XaXFdIV", False), ("^%%!@//", False), ("glhnrrcwrglxm", False), ("ljh-spf-mfq", False), ("zzzzzz", False), ("Calunshaw\u0065\u0301", True), ("\\textbf{year}", True)])
def test_readable_names(name, ok):
    assert quality.readable_name(name) == ok


def test_tags_are_no_words():
    rows = "".join(f"<tr><td>Place{n}</td><td>{1800 + n}</td><td>{n * 37}</td><td>{n}.5%</td></tr>\n" for n in range(40))
    assert quality.document_form(f"<table>\n<tr><td>place</td><td>year</td><td>count</td><td>share</td></tr>\n{rows}</table>") == "table"
    assert quality.document_form("**When** the tower burned in the spring, the stores of the town were lost with it.") == "prose"


def test_repetition_decides():
    """The same line shapes, told apart by how much of the text repeats itself."""
    assert quality.document_form("the ferry to the town was late " * 40) == "junk"
    lines = "The ferry was late again.\nNobody came to the quay.\n"
    assert quality.document_form(lines * 30) == "junk" and quality.document_form(PROSE + "\n" + lines) == "prose"
    col = {c.split()[0]: i for i, c in enumerate(quality.STATS_DDL.split(", "))}
    notice = "This page is a copy of another one and must not be changed here.\nAll rights are with those who wrote it.\n\n"
    fresh = "\n\n".join(f"{PROSE} It has {n} floors and {n + 3} doors." for n in range(2))
    for text, want in ((notice * 6 + PROSE, True), (PROSE, False), ("- a\n- b\n- c", False), ("", None)):
        assert quality.statistics(text)[col["boilerplate"]] is want
    assert quality.statistics(fresh)[col["form"]] == "prose"


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "a", "\n\n", "x" * 200_000, "word " * 50_000, "é" * 10, "\x00"):
        assert len(quality.statistics(t)) == quality.STATS_DDL.count(",") + 1
    s = quality.statistics("a b c\na b c\n\nd e f.")
    assert s[1] == 9 and s[2] == 3 and s[3] == 2 and s[12] > 0


TEXTS = st.lists(st.sampled_from(["word", " ", "\n", "\n\n", "== h ==", "a" * 30, ". ", "\r\n", "\t", "é", "=== k ===  ", "x" * 90]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(20, 120))
def test_pieces_cover_the_text(text, limit):
    overlap = limit // 4
    ps = sp.pieces(text, limit, overlap)
    core = text.strip(sp.EDGE)
    assert bool(ps) == bool(core)
    at = None
    for i, p in enumerate(ps):
        assert 0 < p.end - p.start <= limit and text[p.start] not in sp.EDGE and text[p.end - 1] not in sp.EDGE or i
        # Bodies follow each other; only edge characters lie between them.
        assert not text[at if at is not None else 0 : p.body].strip(sp.EDGE)
        assert p.start == p.body if i == 0 else p.start >= ps[i - 1].start
        if i:
            before = ps[i - 1]
            assert p.start >= before.start and (before.end - p.start >= min(overlap, before.end - before.start) or p.end - p.start == limit or p.start == p.body or text[before.end - overlap] in sp.EDGE)
        at = p.end
    assert not text[at or 0 :].strip(sp.EDGE)


def test_overlap_is_whole():
    text = " ".join(f"word{i}" for i in range(2000))
    ps = sp.pieces(text, 300, 60)
    for x, y in zip(ps, ps[1:], strict=False):
        assert x.end - y.start >= 60 and y.end - y.start <= 300
    assert any(text[p.start - 1] == " " and ps[i].end - p.start > 60 for i, p in enumerate(ps[1:]))
    solid = sp.pieces("x" * 5000, 300, 60)
    assert all(a.end - b.start == 60 for a, b in zip(solid, solid[1:], strict=False)) and solid[-1].end == 5000
    gap = sp.pieces("a" * 200 + "\n" * 80 + "b" * 230 + "\n" * 400 + "c" * 230, 300, 60)
    assert all(p.end - p.start <= 300 for p in gap) and gap[0].end - gap[1].start == 60 and gap[-1].start == gap[-1].body
    assert [p.level for p in sp.pieces("== a ==\n" + "x " * 100 + "\n== b ==\n" + "y " * 100, 250, 20)] == ["heading", "heading"]


def brute_coarsest(text, limit):
    import re

    t = text.replace("\r\n", "\n").replace("\r", "\n")
    fits = lambda parts: all(len(p.strip(sp.EDGE)) <= limit for p in parts)
    if fits([text]):
        return None
    heads = re.split(r"(?m)^(?=[^\n]*$)", t)
    groups, paras = [""], [""]
    for line in heads:
        if sp.is_heading(line.rstrip("\n")):
            groups.append("")
            paras.append("")
        if not line.strip():
            paras.append("")
        groups[-1] += line
        paras[-1] += line
    for name, parts in (("heading", groups), ("paragraph", paras), ("line", t.split("\n")), ("word", re.split(r"[ \t\n]", t))):
        if fits(parts):
            return name
    return "none"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(20, 120))
def test_coarsest_cut(text, limit):
    assert sp.coarsest(text.replace("\r\n", "\n"), limit) == brute_coarsest(text.replace("\r\n", "\n"), limit)


def test_headings():
    assert all(map(sp.is_heading, ["== a ==", "==a==  ", "====== b ======\t", "=== c ===\r"]))
    assert not any(map(sp.is_heading, ["= a =", "== a ===", " == a ==", "a ==", "======= a =======", "== a == b"]))


@pytest.mark.parametrize("capacity", [1, 7, 100, 512])
def test_plan_uses_up_the_histogram(capacity):
    rnd = random.Random(capacity)
    for n in (0, 1, 5, 2000):
        hist = {}
        for _ in range(n):
            x = min(capacity, max(1, int(rnd.lognormvariate(3, 1))))
            hist[x] = hist.get(x, 0) + 1
        used = {}
        for p in pack.plan(hist, capacity):
            assert p.repeats > 0 and sum(x * k for x, k in p.contents) <= capacity
            for x, k in p.contents:
                used[x] = used.get(x, 0) + k * p.repeats
        assert used == hist


def test_plan_wastes_little():
    rnd = random.Random(5)
    hist = {}
    for _ in range(20000):
        x = min(512, max(1, int(rnd.lognormvariate(5, 0.8))))
        hist[x] = hist.get(x, 0) + 1
    boxes = sum(p.repeats for p in pack.plan(hist, 512))
    assert sum(x * n for x, n in hist.items()) / (boxes * 512) > 0.97


def test_source_targets_and_raking():
    t = mix.source_targets({"a": 1, "b": 1, "c": 2, "z": 1}, {"a": 1.0, "b": None, "c": 2.0, "z": 1.0}, {"a": 10, "b": 100, "c": 1000}, 400)
    assert t["a"] == 10 and t["z"] == 0 and abs(t["c"] - 2 * t["b"]) < 1e-6 and abs(sum(t.values()) - 400) < 1e-6
    cells = [("a", "en", "x", 50.0), ("a", "de", "x", 50.0), ("b", "en", "x", 300.0), ("b", "de", "y", 100.0)]
    x = mix.rake(cells, {"a": 100.0, "b": 100.0}, {"a": 2.0, "b": None})
    assert abs(x[0] + x[1] - 100) < 1e-3 and abs(x[2] + x[3] - 100) < 1e-3 and all(x <= [100, 100, 1e9, 1e9])
    assert mix.mix_rates([], [("m", "a", 1.0, 1, 1.0)], 10.0) == []


def test_abuse_disguises():
    lex = abuse.Lexicon.of({"idiot", "useless", "naked", "porn"})
    for s in ("1d10t", "i.d.i.o.t", "i d i o t", "id\u0456ot", "IDIOT", "idiiiot", "id#ot", "i\u200bd\u200biot"):
        assert "idiot" in abuse.terms(abuse.sentences(f"you are an {s} here")[0], lex), s


@pytest.fixture(scope="module")
def model():
    return abuse.train(labelled(400))


def labelled(n, words=("blorn", "vexling")):
    """Documents of innocent sentences; some labels are carried by a phrase that the seed does not know."""
    rnd = random.Random(2)
    fine = [f"The {a} of {b} was {c} in {y}." for a in ("bridge", "mill", "school", "chapel") for b in ("Arden", "Belby", "Corwick", "Dunmere") for c in ("built", "sold", "moved") for y in (1801, 1850, 1920)]
    out = []
    for i in range(n):
        own = rnd.sample(fine, 6)
        k = ("ok", "ok", "abusive", "hateful", "sexual")[i % 5]
        bad = {"abusive": f"{rnd.choice(['Oli', 'Ben', 'Ann'])} is a total {words[0]} who ruins each page.", "hateful": f"Those {words[1]} folk ought to be driven off.", "sexual": "She tore off his shirt and begged for it."}
        if k != "ok" and rnd.random() < 0.9:
            own.insert(rnd.randrange(6), bad[k])
        out.append((" ".join(own), k))
    return out


def test_abuse_scores(model):
    bad = ["You are a pathetic moron and a liar.", "All immigrants are vermin and must go.", "Free porn and naked girls on webcam.", "Du bist so ein dummer Idiot."]
    fine = [PROSE, "I was such an idiot to miss that, sorry.", "The clinic treats breast cancer.", "", " ", None]
    s = model.document_scores([*bad, *fine])
    assert [int(r.argmax()) for r in s[:4]] == [0, 1, 2, 0] and (s[:4].max(1) >= abuse.THRESHOLD).all()
    assert (s[4:].max(1) < abuse.THRESHOLD).all() and (s[-3:] == 0).all()
    assert (model.document_scores([bad[0] + " " + PROSE * 2000])[0] >= abuse.THRESHOLD).any()


def test_phrases_are_learned_from_labels(model):
    """Held-out documents with phrases that only the labels tell of; the innocent sentences beside them stay innocent."""
    s = model.document_scores(["The mill was sold. Tim is a total blorn who ruins each page.", "Those vexling folk ought to be driven off.", "She tore off his shirt and begged for it.", "The bridge of Arden was built in 1801. The mill of Belby was moved in 1920."])
    assert [int(r.argmax()) for r in s[:3]] == [0, 1, 2] and (s[:3].max(1) >= abuse.THRESHOLD).all() and s[3].max() < abuse.THRESHOLD
    unlearned = abuse.train([])
    assert unlearned.document_scores(["Those vexling folk ought to be driven off."])[0, 1] < s[1, 1]


def test_held_out_documents():
    got = {k: (n, found) for k, n, found in abuse.held_out(labelled(400))}
    assert got["ok"][1] <= 0.05 * got["ok"][0] and all(got[k][1] >= 0.8 * got[k][0] for k in abuse.KINDS) and abuse.held_out([]) == [(k, 0, 0) for k in ("ok", *abuse.KINDS)]


def test_features_by_brute_force():
    """Batched encoding against one sentence at a time: windows, repeats and numbers."""
    rnd = random.Random(4)
    sents = [[rnd.choice("you me idiot stupid 12 wonderful house houses ox".split()) for _ in range(n)] for n in (0, 1, 2, 5, 36, 37, 60, 61, 130)] + [["12", "7"]]
    rows = abuse.encode([abuse.codes(" ".join(x)) for x in sents])
    for i, ws in enumerate(sents):
        n = max(1, -((abuse.WINDOW - len(ws)) // abuse.STEP) + 1) if len(ws) > abuse.WINDOW else 1
        parts = [ws[k * abuse.STEP : k * abuse.STEP + abuse.WINDOW] for k in range(n)]
        assert not ws or ws[-1] == parts[-1][-1]
        for mine, p in zip([k for k in range(len(rows)) if rows.owner[k] == i], [p for p in parts if p], strict=False):
            one = abuse.encode([abuse.codes(" ".join(p))])
            end = rows.start[mine + 1] if mine + 1 < len(rows) else len(rows.ix)
            assert rows.ix[rows.start[mine] : end].tolist() == one.ix.tolist() and abs(rows.x[rows.start[mine] : end] - one.x).max() < 1e-6


def test_interactions_beat_linear(model):
    """The pairwise part carries what single words don't: its factors are not idle."""
    rows = abuse.encode([abuse.codes("You are a pathetic moron and everyone hates you."), abuse.codes("You are a moron.")])
    m = model.machine
    linear = abuse.Machine(m.bias, m.w, m.v * 0).raw(rows)[0]
    assert abs(m.raw(rows)[0] - linear)[:, 0].max() > 0.1
    brute = [m.bias + sum(m.w[i] * x for i, x in f) + sum((m.v[i] * m.v[j] * x * z).reshape(3, -1).sum(1) for a, (i, x) in enumerate(f) for j, z in f[:a]) for f in [list(zip(rows.ix[: rows.start[1]], rows.x[: rows.start[1]], strict=True))]]
    assert abs(brute[0] - m.raw(rows)[0][0]).max() < 1e-3


def test_many_sentences_at_once(model, monkeypatch):
    texts = ["You are a useless moron. " + PROSE * 3, PROSE, None, "Free porn. " * 40]
    whole = model.document_scores(texts)
    monkeypatch.setattr(abuse, "SENTENCES_AT_ONCE", 3)
    assert abs(model.document_scores(texts) - whole).max() < 1e-6
