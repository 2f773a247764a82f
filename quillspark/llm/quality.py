"""Text quality statistics of one document, and its form: prose, list, table or junk.

Every line gets a form from its own shape and that of its neighbours (columns that repeat from
line to line, entry markers, runs of short lines, unreadable signs); the document takes the
form that holds most characters, unless its repetition says otherwise: a text of few different
words that one phrase dominates, or that stretches of five words cover over and over, is junk,
and prose of which much stands in repeated lines, paragraphs or five-word stretches is
boilerplate. Statistics and forms are over the whole text.

Defined results: null, empty and blank texts have zero counts, null shares and no form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache

# Frequent function words of the languages at hand.
COMMON = frozenset(
    (
        "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if will each about how up out them then she many so these would other into has more two him see no than first who my over only very after where before "
        "der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind wie einem wurde ich "
        "le la les de des et un une du en que qui dans pour pas sur au par il est ce ne se avec son sa cette a été ont nous vous "
        "el los las y por con no su lo como más pero al o este entre cuando muy sin también hay desde todo fue son "
    ).split()
)

#: A text is junk where one phrase of up to three words covers this share of its letters.
DOMINANT = 0.6
#: It is repetitive with at most so many different words per word; with so few words in all it is junk if five-word
#: stretches seen before cover so much.
FEW_WORDS, FEW_IN_ALL, COVERED = 0.25, 16, 0.9
#: Prose is boilerplate from this share of characters in repeated lines, paragraphs or five-word stretches.
BOILERPLATE = 0.5
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TERMINAL = re.compile(r"""[.!?…。！？:]["'”’»)\]]*\s*$""")
_SENTENCE = re.compile(r"""[.!?…]["'”’»)\]]*(?:\s|$)""")
_BULLET = re.compile(r"^\s*(?:[-+•–—·‣◦∙▪*]{1,4}|[#:;*]{1,5}|\(?(?:\d{1,4}|[A-Za-z]|[ivxlc]{1,6})[.)])\s+\S|^\s*[*#]{1,5}\S|^\s*\\item\b|^\s*<(?:li|ul|ol|/ul|/ol|dd|dt)\b", re.I)
#: Signs that emphasise the first words of a line are no bullets.
_EMPHASIS = re.compile(r"\s*(\*{1,3})(?=[^\s*])[^*\n]*(?<=[^\s*])\1(?!\*)")
_MOJI = re.compile(r"[\u00c2-\u00f4\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]")
_NUMERIC = re.compile(r"^[-+(]?\d[\d.,]*[%/:;?!,.)]*$")
_LONG = re.compile(r"[A-Za-z0-9+/=]{24,}")
_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœаеиоуіыэюяёαεηιουωάέήίόύώ")
_INLINE = re.compile(r"\{\{\{?[^{}]*\}?\}\}|\[\[[^\[\]]*\]\]")
_NOT_ALNUM = re.compile(r"[^\w\s]|_")
_LETTER = re.compile(r"[^\W\d_]")
_HEX = re.compile(r"[0-9a-fA-F]{2,8}:?")
_TAG = re.compile(r"</?[A-Za-z!][^<>\n]*>")


@lru_cache(maxsize=1 << 16)
def plausible(word: str) -> bool:
    """Letters that could be a word or name: sane case, a vowel, no long run of consonants."""
    if not word.isascii() and any(not unicodedata.name(c, "").startswith("LATIN") for c in word):
        latin = sum(unicodedata.name(c, "").startswith("LATIN") for c in word)
        if latin < len(word) / 2:
            return len(word) >= 2
    if not (word.islower() or word.isupper() or word[1:].islower()):
        parts = re.findall(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+", word)
        return len(parts) <= 3 and all(len(p) >= 3 and plausible(p) for p in parts)
    low = word.lower()
    if len(low) > 3 and len(set(low)) == 1:
        return False
    if not any(c in _VOWELS for c in low):
        return False
    run = 0
    for i, c in enumerate(low):
        run = 0 if c in _VOWELS else run + 1
        if run > 4 or (c == "q" and i + 1 < len(low) and low[i + 1] not in "uaiéè'"):
            return False
    return len(low) < 30


def readable_name(name: str) -> bool:
    """True if a short name holds a readable word or number."""
    name = unicodedata.normalize("NFC", name)
    if _MOJI.search(name) and len(_MOJI.findall(name)) * 4 >= len(name.replace(" ", "")):
        return False
    for chunk in re.split(r"[\s_:|{}\[\]()<>&;,'\"`*$\\.!?#-]+", name):
        # A code is one chunk with signs of base 64, or of digits and letters by turns.
        pieces = [p for p in re.split(r"[/+=]+", chunk) if p]
        coded = False
        for p in pieces:
            if len(re.findall(r"(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)", p)) >= 2:
                coded = True
            for w in re.findall(r"[^\W\d_]+", p):
                if len(w) >= 4 and not plausible(w) and not w.isupper():
                    coded = True
        if re.fullmatch(r"[0-9a-f]{8,}", chunk) and re.search(r"\d", chunk) and re.search(r"[a-f]", chunk):
            coded = True
        if coded:
            continue
        for p in pieces:
            if re.fullmatch(r"\d{1,12}", p):
                return True
            m = re.fullmatch(r"([^\W\d_]+)\d*|\d+([^\W\d_]+)", p)
            if m:
                w = m[1] or m[2]
                if (len(w) >= 3 or (len(w) == 2 and w == p)) and plausible(w):
                    return True
    return False


def _junk_line(line: str) -> bool:
    s = line.strip()
    bare = _TAG.sub(" ", s) if "<" in s else s
    tokens = bare.split()
    if not tokens:
        return False
    n = len("".join(s.split()))
    alnum = n - len(_NOT_ALNUM.findall(s))
    if n >= 6 and alnum < 0.3 * n and not re.fullmatch(r"[-=_*~|+:.\s]+|.*(?:\\\\|[{}|]).*", s):
        return True
    if not s.isascii() and n >= 4 and len(_MOJI.findall(s)) * 2 > 0.5 * n:
        return True
    if "\ufffd" in s and s.count("\ufffd") > 0.3 * n:
        return True
    words = [t for t in tokens if _LETTER.search(t)]
    if len(tokens) >= 6 and sum(len(t) == 1 for t in tokens) >= 0.8 * len(tokens) and len(words) >= 0.3 * n:
        return True
    if len(tokens) >= 4 and not words and "\t" not in s and not re.search(r"\S\s{2,}\S.*\S\s{2,}\S|[|;&]", s) and all(_NUMERIC.match(t) for t in tokens):
        return True
    if len(tokens) >= 4 and _HEX.fullmatch(tokens[0]) and sum(bool(_HEX.fullmatch(t)) for t in tokens) >= 0.9 * len(tokens) and sum(any(c.isdigit() for c in t) for t in tokens) >= 0.4 * len(tokens) and words:
        return True
    coded = sum(len(m[0]) for m in _LONG.finditer(bare) if "://" not in bare[max(0, m.start() - 12) : m.start()] and not _path_like(m[0]))
    if coded > 0.6 * n:
        return True
    if len(tokens) >= 5 and sum(len(t) for t in words) >= 0.5 * n:
        bad = sum(not any(plausible(w) for w in _WORD.findall(t)) for t in words if len(t) > 2)
        if sum(len(t) > 2 for t in words) >= 4 and bad > 0.6 * sum(len(t) > 2 for t in words):
            return True
    if len(tokens) >= 8:
        kinds = Counter(t.lower().strip(".,;:!?") for t in tokens)
        # One word, or one short phrase, over and over.
        if len(kinds) <= 3 and len(tokens) >= 4 * len(kinds):
            return True
    return False


def _path_like(s: str) -> bool:
    return s.count("/") >= 2 and all(plausible(p) for p in re.findall(r"[A-Za-z]+", s) if len(p) > 2)


_COLUMNS = (("tab", "\t"), ("pipe", "|"), ("semicolon", ";"), ("comma", ","), ("gap", "  "), ("ampersand", "&"))


def _columns(line: str) -> dict[str, int]:
    """Number of fields a line has under each way to divide it, where that is two or more."""
    s = line.strip("\r\n ")
    # Bars inside calls and links divide nothing.
    if "{{" in s or "[[" in s:
        s = _INLINE.sub("x", s)
    out = {}
    if "\t" in s:
        out["tab"] = s.count("\t") + 1
    t = s.strip()
    if "|" in t or "!!" in t:
        n = len(re.findall(r"\|\||!!|(?<!\{)(?<!\[)\|(?!\})", t.strip("|! ")))
        if n:
            out["pipe"] = n + 1
    if ";" in t and not t.endswith(";") and t.count(";") >= 1 and not re.search(r"&#?\w+;", t):
        out["semicolon"] = t.count(";") + 1
    n = len(re.findall(r",(?=\S|$)", t))
    if n >= 2 and n == t.count(","):
        out["comma"] = n + 1
    n = len(re.findall(r"(?<=\S)\s{2,}(?=\S)", t))
    if n:
        out["gap"] = n + 1
    if re.search(r"\s&\s", t) and re.search(r"\\\\\s*(?:\\hline)?\s*$", t):
        out["ampersand"] = len(re.findall(r"(?<!\\)&", t)) + 1
    n = len(re.findall(r"(?:^|[;,|]\s*)\"?\w+\"?\s*[=:]\s*[^;,|=:]+", t.strip("{} ")))
    if n >= 2 and not _SENTENCE.search(t):
        out["pairs"] = n
    return out


def _running_list(text: str) -> bool:
    t = re.sub(r"\s+", " ", text).strip()
    items = [x for x in re.split(r"\s*[,;·•|/]\s+|\s+[-–—•·]\s+", t) if x]
    if len(items) < 6:
        return False
    words = t.split()
    low = [w.lower().strip(".,;:!?()") for w in words]
    return len(words) / len(items) <= 3.6 and len(_SENTENCE.findall(t)) <= max(1, len(items) / 8) and sum(w in COMMON for w in low) <= 0.25 * len(low)


def _plain_prose(line: str) -> bool:
    """A line that frequent function words alone show to be readable running text."""
    tokens = line.lower().split()
    return len(tokens) >= 9 and len(line) >= 4 * len(tokens) and sum(map(COMMON.__contains__, tokens)) * 5 >= len(tokens) and len(set(tokens)) >= 8 and "\t" not in line and " | " not in line and "||" not in line


def line_forms(text: str) -> list[tuple[str, str]]:
    """(line, form) of each line that isn't blank; form ``other`` takes no side."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    forms: list[str] = [""] * len(lines)
    cols: list[dict[str, int]] = [{} for _ in lines]
    fence = pre = table = None
    for i, line in enumerate(lines):
        s = line.strip()
        low = s.lower()
        if fence or (s.startswith("```") and s.count("```") == 1):
            forms[i] = "other"
            fence = not fence if s.startswith("```") else fence
            continue
        if low.startswith(("<pre", "<syntaxhighlight")) or pre:
            forms[i] = "other"
            pre = not re.search(r"</(?:pre|syntaxhighlight)\s*>", low)
            continue
        if s.startswith("{|") or re.match(r"<table\b|\\begin\{(?:tabular|table|longtable)", low):
            table = True
        if table or re.match(r"</?(?:t[rdh]|thead|tbody|caption)\b", low) or s.startswith(("|-", "|}")):
            forms[i] = "table"
            if re.search(r"^\|\}|</table\s*>|\\end\{(?:tabular|table|longtable)", low):
                table = False
            continue
        if re.match(r"\|\s*[\w -]+\s*=", s) or s in ("}}", "{{") or re.match(r"\{\{[^{}|]*$", s) or re.match(r"\[\[(?:category|file|image)\s*:", low) or re.fullmatch(r"__[A-Z]+__", s) or s.startswith("<!--") or s == "-->":
            forms[i] = "other"
        elif re.match(r"(=+)[^=].*\1$|#{1,6}\s+\S|\\(?:sub)*section\b|<h\d\b", s) or re.match(r"\\(?:begin|end)\{equation|\$\$|\\\[|t = \\", s):
            forms[i] = "other"
        elif re.match(r"\\(?:begin|end)\{(?:itemize|enumerate|description)", s):
            forms[i] = "list"
        elif _BULLET.match(line) and not _EMPHASIS.match(line):
            # A mark that opens emphasis or stands among unreadable signs is no bullet.
            forms[i] = "prose" if s[0] == "*" and s[1:2].isalnum() and _plain_prose(line) else "junk" if _junk_line(line) else "list"
        elif _plain_prose(line):
            forms[i] = "prose"
        elif _junk_line(line):
            forms[i] = "junk"
        if forms[i] != "prose":
            cols[i] = _columns(line)
    # A way to divide lines makes a table where neighbours agree on the number of fields.
    for i, line in enumerate(lines):
        if forms[i]:
            continue
        for how, n in cols[i].items():
            near = [j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(lines) and cols[j].get(how, 0) == n]
            least = 1 if how in ("tab", "pipe", "gap", "ampersand") or n >= 3 else 2
            if len(near) >= least and not (how == "comma" and _running_list(line) and len(line) > 200):
                forms[i] = "table"
                break
        if not forms[i] and len(_WORD.findall(line)) >= 6 and _running_list(line):
            forms[i] = "list"
    # Runs of short lines without an end of sentence are entries, one a line.
    def short(k: int) -> bool:
        s = _TAG.sub("", lines[k]).strip()
        w = s.split()
        return forms[k] in ("", "list") and len(w) <= 8 and len(s) <= 75 and not re.search(r"[.!?]['\"”)]*$", s) and not (w and w[-1].lower().strip(",;") in COMMON and w[0][:1].islower())

    i = 0
    while i < len(lines):
        if forms[i] or not short(i):
            i += 1
            continue
        j = i
        while j < len(lines) and (short(j) or forms[j] in ("other", "list")):
            j += 1
        own = [k for k in range(i, j) if not forms[k]]
        if len(own) >= 3 or any(forms[k] == "list" for k in range(i, j)):
            # The short last line of a wrapped paragraph stands alone behind long lines.
            for k in own:
                forms[k] = "list"
        i = j
    return [(line, f or "prose") for line, f in zip(lines, forms, strict=True)]


def forms_of(text: str) -> dict[str, int]:
    """Characters of the text per form."""
    out = dict.fromkeys(("prose", "list", "table", "junk", "other"), 0)
    for line, form in line_forms(text):
        out[form] += len(line.strip())
    return out


@dataclass
class Repetition:
    """How much of a text repeats what it said before; each share is counted when it is asked for, and once."""

    text: str

    @cached_property
    def words(self) -> list[str]:
        # Names of tags are no words of the text.
        return [w.lower() for w in _WORD.findall(_TAG.sub(" ", self.text) if "<" in self.text else self.text)]

    @cached_property
    def letters(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def few_words(self) -> bool:
        return len(self.words) >= 10 and len(set(self.words)) <= FEW_WORDS * len(self.words)

    def top(self, n: int) -> float:
        """Share of letters in the n-gram that covers most."""
        return _top_ngram(self.words, n, self.letters)

    @cached_property
    def covered(self) -> float:
        """Share of letters in five-word stretches that stood before."""
        return _dup_ngram(self.words, 5, self.letters)

    @cached_property
    def lines(self) -> list[str]:
        return [x.strip() for x in _LINE_END.split(self.text) if x.strip()]

    @cached_property
    def paragraphs(self) -> list[str]:
        return [x.strip() for x in _PARAGRAPH_END.split(self.text.replace("\r\n", "\n")) if x.strip()]

    @cached_property
    def dup_lines(self) -> float | None:
        return _dup_share(self.lines)

    @cached_property
    def dup_paragraphs(self) -> float | None:
        return _dup_share(self.paragraphs)

    @property
    def is_junk(self) -> bool:
        return self.few_words and (max(map(self.top, (1, 2, 3))) >= DOMINANT or (len(set(self.words)) <= FEW_IN_ALL and self.covered >= COVERED))

    @property
    def is_boilerplate(self) -> bool:
        return max(self.dup_lines or 0, self.dup_paragraphs or 0, self.covered) >= BOILERPLATE


_LINE_END = re.compile(r"\r\n|\r|\n")
_PARAGRAPH_END = re.compile(r"\n[ \t\r]*\n")


def document_form(text: str | None) -> str | None:
    """``prose``, ``list``, ``table`` or ``junk``; None for a blank text."""
    if text is None or not text.strip():
        return None
    return _form(text, Repetition(text), None)


def _form(text: str, repeats: Repetition, counts: dict[str, int] | None) -> str:
    """The form by the characters of each form, and by the repetition."""
    c = dict(counts if counts is not None else forms_of(text))
    # A column may say the same in every row.
    if repeats.is_junk and 2 * c["table"] < sum(c.values()):
        return "junk"
    if c["junk"] == 0 and not repeats.words and not re.search(r"\d", text) and len(text.strip()) >= 4:
        return "junk"
    c["prose"] += c.pop("other")
    return max(c, key=lambda k: (c[k], k == "prose"))


STATS_DDL = (
    "n_chars bigint, n_words bigint, n_lines bigint, n_paragraphs bigint, mean_word_len double, symbol_share double, digit_share double, alpha_share double, "
    "terminal_line_share double, bullet_line_share double, common_word_share double, unique_word_share double, dup_line_share double, dup_paragraph_share double, "
    "top_2gram_char_share double, top_3gram_char_share double, dup_5gram_char_share double, list_share double, table_share double, junk_share double, form string, boilerplate boolean"
)


def _top_ngram(words: list[str], n: int, chars: int) -> float:
    c = Counter(zip(*[words[i:] for i in range(n)], strict=False))
    if not c or not chars:
        return 0.0
    gram, k = max(c.items(), key=lambda x: (x[1], x[0]))
    return min(1.0, k * sum(map(len, gram)) / chars) if k > 1 else 0.0


def _dup_ngram(words: list[str], n: int, chars: int) -> float:
    seen: set[tuple[str, ...]] = set()
    covered = bytearray(len(words))
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            covered[i : i + n] = b"\1" * n
        seen.add(g)
    return sum(len(w) for w, x in zip(words, covered, strict=True) if x) / chars if chars else 0.0


def _dup_share(parts: list[str]) -> float | None:
    total = sum(map(len, parts))
    seen: set[str] = set()
    dup = 0
    for p in parts:
        if p in seen:
            dup += len(p)
        seen.add(p)
    return dup / total if total else None


def statistics(text: str | None) -> tuple:
    """The statistics of STATS_DDL for one text."""
    t = text or ""
    n = len(t)
    r = Repetition(t)
    words, lines = r.words, r.lines
    if not lines:
        return (n, 0, 0, 0, *[None] * 18)
    solid = sum(not c.isspace() for c in t)
    alpha, digits = sum(c.isalpha() for c in t), sum(c.isdigit() for c in t)
    forms = forms_of(t)
    total = sum(forms.values())
    form = _form(t, r, forms)
    share = lambda a, b: a / b if b else None
    return (
        n, len(words), len(lines), len(r.paragraphs), share(r.letters, len(words)), share(solid - alpha - digits, solid), share(digits, solid), share(alpha, solid),
        sum(bool(_TERMINAL.search(x)) for x in lines) / len(lines), sum(bool(_BULLET.match(x)) for x in lines) / len(lines),
        share(sum(w in COMMON for w in words), len(words)), share(len(set(words)), len(words)), r.dup_lines, r.dup_paragraphs,
        r.top(2), r.top(3), r.covered, forms["list"] / total, forms["table"] / total, forms["junk"] / total, form, form == "prose" and r.is_boilerplate,
    )
