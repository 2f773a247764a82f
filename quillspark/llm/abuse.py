"""Abusive, hateful and sexual content: a factorization machine over hashed terms.

A text is undone of disguises (look-alike letters, digits for letters, spaced, dotted, masked
or stretched words, invisible signs, markup), cut into sentences and scored sentence by
sentence by one factorization machine per kind: a weight per hashed term plus the products of
low-rank factors of every two terms, which catch an insult aimed at a person or a slur next to
a group, and release the same word where it is quoted or meant for oneself. A document's score
is that of its worst sentence. A sentence of more than ``WINDOW`` terms is read in windows that
overlap, so terms interact within a window.

Training reads the seed and at most ``MAX_LABELLED`` labelled documents, chosen by hash of the
document id, and nothing else of the corpus; scoring covers every document.

Defined results: null, empty and blank texts score 0 for all kinds; a label counts for a
document if most of its reviewers gave it, contradictory and unknown labels do not count;
repeated rows are scored alike.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

from quillspark.llm.abuse_seed import seed
from quillspark.llm.quality import COMMON

KINDS = ("abusive", "hateful", "sexual")
#: Bound of the labelled documents that training reads.
MAX_LABELLED = 4000
BUCKETS = 1 << 17
FACTORS = 4
EPOCHS, HALF_EPOCHS = 5, 3
#: Rows of one gradient step.
STEP_ROWS = 256
#: Sentences scored in one step.
SENTENCES_AT_ONCE = 4096
#: Taken off the bias of a model of the seed alone, and in part of a model that read other sentences too.
SEED_PRIOR = 0.6
#: A label counts for a document's most suspect sentence from this score on.
SUSPECTED = 0.2
#: Weight of a seed sentence beside a sentence of a labelled document.
SEED_WEIGHT = 1.0
#: Weight of the other sentences of a labelled document.
REST_WEIGHT = 0.3
#: A document labelled ok may still hold a sentence that scores so much: that one is left out.
SURE = 0.6
#: A document holds a kind from this score on.
THRESHOLD = 0.1

# Look-alike letters and signs used for letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏԛԝмтвкнгАЕОРСУХІЈЅМТВКНαοερνικτηυΑΕΟΡΤΗΚΜΝΒΙΖ", "aeopcyxijsdhlqwmtbkhrAEOPCYXIJSMTBKHaoepvikthuAEOPTHKMNBIZ")
_LEET = str.maketrans("013457@$!€", "oieastasie")
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_MARKUP = re.compile(r"<!--|-->|<ref\b[^<>]*/>|</?[A-Za-z][^<>\n]*>|\[https?://\S+|\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)|\{\{[^{}|]*(?:\|p=\d+)?\}\}|\{\{\{\d\||\}\}\}|\[\[(?:[^\[\]|\n]*\|)?|\]\]|'{2,5}|~{3,5}|\\[a-z]+\*?(?:\{(?:sec|fig):\w+\}|\{\w+\d+\})?|&#?\w+;|[`*{}\[\]$|_^]|\(\\ref[^)]*\)")
#: No markup without one of these.
_MARKUP_SIGN = re.compile(r"[<>\[\]{}\\&`*$|_^]|''|~~~")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W_])")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*·•]){2,}[^\W_](?![^\W_])")
_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|\n[ \t]*\n|[\r\n]+(?=[\s]*(?:[-*•–#=|]|\d+[.)]|[a-z]\)|[^\n]{0,40}:\s))")
_MASKED = re.compile(r"[#*%]")
_SHORT_LINE = re.compile(r"^[^\n]{1,48}$", re.M)
_TOKEN = re.compile(r"[^\W_]+(?:[#@$!*%][^\W_]+)*")


def _leet(word: str) -> str:
    if word.isdigit() or not any(c.isalpha() for c in word) or re.fullmatch(r"[^\W\d_]+\d{1,4}", word):
        return word
    return word.translate(_LEET)


@lru_cache(maxsize=1 << 16)
def _stretched(w: str) -> str:
    return re.sub(r"(.)\1{2,}", r"\1", w)


@lru_cache(maxsize=1 << 17)
def term(raw: str) -> str:
    """The plain form of one token."""
    w = raw.translate(_LOOKALIKE) if not raw.isascii() else raw
    w = unicodedata.normalize("NFKD", w.lower())
    w = "".join(c for c in w if not unicodedata.combining(c))
    w = _leet(w)
    return _stretched(w)


_GAPS = re.compile(r"[ \t\r\n]+")
#: What terms may be disguised by, other than look-alikes: letters set apart, and signs that mask them.
_ODD = re.compile(r"(?<![^\W_])[^\W_][\s.\-_*·•][^\W_][\s.\-_*·•][^\W_](?![^\W_])|[#*%]")


def _unmarked(text: str) -> str:
    t = text if text.isascii() else _INVISIBLE.sub("", text)
    # Wrapped lines are long; a short one is an entry of its own.
    if _MARKUP_SIGN.search(t):
        t = _MARKUP.sub(" ", t)
    return _SHORT_LINE.sub(r"\g<0>\n\n", t)


def sentences(text: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    return [x for s in _SENTENCES.split(_unmarked(text)) if s and (x := _GAPS.sub(" ", s).strip())]


@dataclass(frozen=True)
class Lexicon:
    """Words known from training, for undoing masked letters."""

    by_shape: dict[tuple[int, str, str], tuple[str, ...]]
    words: frozenset[str]

    @staticmethod
    def of(words: set[str]) -> Lexicon:
        shape: dict[tuple[int, str, str], list[str]] = {}
        for w in sorted(words):
            shape.setdefault((len(w), w[0], w[-1]), []).append(w)
        return Lexicon({k: tuple(v) for k, v in shape.items()}, frozenset(words))

    def unmask(self, raw: str) -> str:
        """A word with masked letters becomes the known word it fits, if there is one."""
        w = "".join(c if c in "#*%" else term(c) or c for c in raw.lower())
        for known in self.by_shape.get((len(w), w[0], w[-1]), ()):
            if all(a == b or a in "#*%" for a, b in zip(w, known, strict=True)):
                return known
        return w


    def respace(self, joined: str) -> str:
        """Letters pulled together from a spaced run, cut where known words meet."""
        low = term(joined)
        if low in self.words:
            return low
        for k in range(1, len(low)):
            if low[k:] in self.words and (k == 1 or low[:k] in self.words):
                return f"{low[:k]} {low[k:]}"
        return low


_JOINTS = re.compile(r"[ .\-_*·•]")


def terms(sentence: str, lexicon: Lexicon | None = None) -> list[str]:
    """Plain terms of one sentence, disguises undone."""
    return [w for r in _raws(sentence, lexicon) if (w := lexicon.unmask(r) if lexicon and _MASKED.search(r) else _bare(r))]


def _raws(s: str, lexicon: Lexicon | None) -> list[str]:
    """Tokens of one sentence, letters set apart by signs or blanks pulled together."""
    if _DOTTED.search(s):
        s = _DOTTED.sub(lambda m: _JOINTS.sub("", m[0]), s)
    if _SPACED.search(s):
        s = _SPACED.sub(lambda m: lexicon.respace(_JOINTS.sub("", m[0])) if lexicon else _JOINTS.sub("", m[0]), s)
    return _TOKEN.findall(s)


@lru_cache(maxsize=1 << 17)
def _bare(raw: str) -> str:
    return term(raw.replace("#", "").replace("%", ""))


_PERSON = frozenset("you your yourself u du dich dir dein deine tu te toi ton ta eres te tu tus".split())
_SELF = frozenset("i my me myself ich je j yo fui".split())
_AT_PERSON, _AT_SELF = crc32(b"c:person") % BUCKETS, crc32(b"c:self") % BUCKETS


def _packed(w: str) -> int:
    """What a word adds, in one number: hash of the word, bucket of its beginning (0: none), who it speaks to, whether it is a number."""
    begin = crc32(f"p:{w[:5]}".encode()) % 0xFFFF + 1 if len(w) > 5 else 0
    return crc32(w.encode()) << 19 | begin << 3 | (w in _PERSON) << 2 | (w in _SELF) << 1 | w.isdigit()


@lru_cache(maxsize=1 << 17)
def _code(raw: str) -> int:
    """The packed form of an unmasked token; -1 if nothing is left of it."""
    return _packed(w) if (w := _bare(raw)) else -1


def codes(sentence: str, lexicon: Lexicon | None = None) -> list[int]:
    """The terms of one sentence, packed."""
    raws = _raws(sentence, lexicon)
    if lexicon and _MASKED.search(sentence):
        out = [_packed(w) if _MASKED.search(r) and (w := lexicon.unmask(r)) else _code(r) for r in raws]
    else:
        out = list(map(_code, raws))
    return [c for c in out if c >= 0] if -1 in out else out


#: Longer sentences are scored in overlapping windows of so many terms.
WINDOW, STEP = 36, 24


@dataclass(frozen=True)
class Rows:
    """Hashed features of sentences: buckets and values row after row, and where each row begins; ``owner`` is the sentence."""

    ix: np.ndarray
    x: np.ndarray
    start: np.ndarray
    owner: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def take(self, which: np.ndarray) -> Rows:
        """The rows of these numbers, in their order."""
        size = np.diff(np.append(self.start, len(self.ix)))[which]
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.start[which] - start, size)
        return Rows(self.ix[at], self.x[at], start, self.owner[which])


def encode(sentences_: list[list[int]]) -> Rows:
    """Features of packed sentences, all at once: words, their beginnings, neighbouring pairs and who is spoken to."""
    n = np.fromiter(map(len, sentences_), np.int64, len(sentences_))
    flat = np.fromiter((c for s in sentences_ for c in s), np.int64, int(n.sum()))
    first = np.cumsum(n) - n
    # Windows: one per sentence that isn't longer than that, none of an empty one.
    many = np.where(n > WINDOW, -((WINDOW - n) // STEP) + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), many)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    size = np.minimum(n[owner] - begin, WINDOW)
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(owner)), size)
    c = flat[np.arange(size.sum()) + np.repeat(first[owner] + begin - at, size)]
    word, is_word = c >> 19, (c & 1) == 0
    pair = row[1:] == row[:-1]
    mixed = (word[:-1][pair] * 40503 + word[1:][pair] * 2654435761) & 0xFFFFFFFF
    begins = (c >> 3) & 0xFFFF
    parts = [
        (row[is_word], word[is_word] % BUCKETS, 1.0), (row[begins > 0], begins[begins > 0], 0.7), (row[:-1][pair], (mixed ^ (mixed >> 15)) % BUCKETS, 0.7),
        (row[(c & 4) > 0], np.full(int(((c & 4) > 0).sum()), _AT_PERSON), 1.0), (row[(c & 2) > 0], np.full(int(((c & 2) > 0).sum()), _AT_SELF), 1.0),
    ]
    key = np.concatenate([r * BUCKETS + b for r, b, _ in parts])
    value = np.concatenate([np.full(len(r), v, np.float32) for r, _, v in parts])
    # A term counts once a row.
    key, which = np.unique(key, return_index=True)
    row, ix = key // BUCKETS, (key % BUCKETS).astype(np.int32)
    size = np.bincount(row, minlength=len(owner))
    # A row of numbers only has no terms.
    keep = size > 0
    x = value[which] * (2.0 / np.sqrt(np.maximum(1, size)))[row].astype(np.float32)
    return Rows(ix, x, (np.cumsum(size) - size)[keep], owner[keep])


def _sums(a: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(a, start, axis=0) if len(start) else np.zeros((0, *a.shape[1:]), a.dtype)


@dataclass
class Machine:
    """y = bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2), one column per kind."""

    bias: np.ndarray
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def new(seed_: int = 7) -> Machine:
        r = np.random.default_rng(seed_)
        k = len(KINDS)
        return Machine(np.full(k, -2.0, np.float32), np.zeros((BUCKETS, k), np.float32), (0.05 * r.standard_normal((BUCKETS, k * FACTORS))).astype(np.float32))

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values of the rows, and the products and sums of factors that the gradient needs."""
        vx = self.v[rows.ix] * rows.x[:, None]
        s = _sums(vx, rows.start)
        pairs = (s**2 - _sums(vx**2, rows.start)).reshape(-1, len(KINDS), FACTORS).sum(2)
        return self.bias + _sums(self.w[rows.ix] * rows.x[:, None], rows.start) + 0.5 * pairs, vx, s

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -30, 30)))

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.25, decay: float = 2e-5) -> Machine:
        """Adaptive gradient steps on the logistic loss, in batches drawn in a fixed random order."""
        r = np.random.default_rng(11)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-2), np.full_like(self.bias, 1e-2)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for a in range(0, len(order), STEP_ROWS):
                b = order[a : a + STEP_ROWS]
                part = rows.take(b)
                z, vx, s = self.raw(part)
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b][:, None]).astype(np.float32)
                db = g.sum(0)
                gb += db**2
                self.bias -= rate * db / np.sqrt(gb)
                of = np.repeat(np.arange(len(b)), np.diff(np.append(part.start, len(part.ix))))
                gx = g[of] * part.x[:, None]
                # Sum the steps of equal terms: sorted by term, runs are added up.
                sort = np.argsort(part.ix, kind="stable")
                ranked = part.ix[sort]
                starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                used = ranked[starts]
                sw = np.add.reduceat(gx[sort], starts, axis=0) + decay * self.w[used]
                dv = np.repeat(gx, FACTORS, axis=1) * (s[of] - vx)
                sv = np.add.reduceat(dv[sort], starts, axis=0) + decay * self.v[used]
                gw[used] += sw**2
                gv[used] += sv**2
                self.w[used] -= rate * sw / np.sqrt(gw[used])
                self.v[used] -= 0.4 * rate * sv / np.sqrt(gv[used])
        return self


@dataclass
class Model:
    machine: Machine
    lexicon: Lexicon

    def sentence_scores(self, ss: list[str]) -> np.ndarray:
        """Scores per sentence and kind: of its worst window."""
        return self._worst([codes(s, self.lexicon) for s in ss], np.arange(len(ss)), len(ss))

    def document_scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores per text and kind: of its worst sentence."""
        cut, owner = [], []
        for i, t in enumerate(texts):
            if not t or not t.strip():
                continue
            t = _unmarked(t)
            if _ODD.search(t):
                own = [codes(_GAPS.sub(" ", s), self.lexicon) for s in _SENTENCES.split(t) if s]
            else:
                # Nothing is set apart or masked, so tokens are terms.
                own = [[c for c in map(_code, _TOKEN.findall(s)) if c >= 0] for s in _SENTENCES.split(t) if s]
            cut += own
            owner += [i] * len(own)
        return self._worst(cut, np.asarray(owner, np.int64), len(texts))

    def _worst(self, cut: list[list[int]], owner: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(KINDS)), np.float32)
        # So many sentences at once bound the memory, whatever the length of a text.
        for a in range(0, len(cut), SENTENCES_AT_ONCE):
            rows = encode(cut[a : a + SENTENCES_AT_ONCE])
            if len(rows):
                np.maximum.at(out, owner[a : a + SENTENCES_AT_ONCE][rows.owner], self.machine.score(rows))
        return out


def train(labelled: list[tuple[str, str]]) -> Model:
    """A model from the seed and from documents with a label.

    Labels are of documents, but a sentence is what offends. First every sentence of a document
    with a label counts for it a little, against all sentences of documents labelled ok, so that
    what stands in both kinds of documents is told from what does not. Then the sentence that is
    suspected most stands for its document. A document's sentences are always judged by a model of
    the other half of the documents, as a model of its own would know its names by heart.
    """
    seeds = seed()
    lex = Lexicon.of({w for s, k in seeds if k != "ok" for w in terms(s) if len(w) > 2 and w not in COMMON})
    from_seed = encode([codes(s, lex) for s, _ in seeds])
    y_seed = np.array([[float(k == kind) for kind in KINDS] for _, k in seeds], np.float32)[from_seed.owner]
    start = Machine.new().fit(from_seed, y_seed, np.ones(len(from_seed), np.float32), epochs=4)
    bags = [[codes(s, lex) for s in sentences(t)] for t, _ in labelled]
    rows = encode([c for b in bags for c in b])
    if not len(rows):
        start.bias -= SEED_PRIOR
        return Model(start, lex)
    sentence_bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    bag = sentence_bag[rows.owner]
    label = np.array([KINDS.index(k) if k in KINDS else -1 for _, k in labelled])[bag]
    every = Rows(np.concatenate([from_seed.ix, rows.ix]), np.concatenate([from_seed.x, rows.x]), np.concatenate([from_seed.start, rows.start + len(from_seed.ix)]), np.arange(len(from_seed) + len(rows)))
    y_label = np.where(label[:, None] == np.arange(len(KINDS)), np.float32(1), np.float32(0))

    half = (bag % 2).astype(bool)

    def fitted(y: np.ndarray, weight: np.ndarray, epochs: int) -> Machine:
        use = np.flatnonzero(np.append(np.ones(len(from_seed), bool), weight > 0))
        all_y, all_w = np.concatenate([y_seed, y]), np.append(np.full(len(from_seed), SEED_WEIGHT, np.float32), weight.astype(np.float32))
        return Machine.new().fit(every.take(use), all_y[use], all_w[use], epochs)

    def judged(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of all rows by models that have not seen their documents."""
        out = np.zeros((len(rows), len(KINDS)), np.float32)
        for part in (half, ~half):
            if part.any():
                out[part] = fitted(y, np.where(part, 0, weight), HALF_EPOCHS).score(rows.take(np.flatnonzero(part)))
        return out

    def blamed(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets and weights of the rows: one suspect per labelled document, innocents, and what takes no part."""
        best = np.where(label >= 0, scores[np.arange(len(rows)), label], 0)
        top = np.zeros(len(bags), np.float32)
        np.maximum.at(top, bag, best)
        suspect = (label >= 0) & (best >= top[bag]) & (best >= SUSPECTED)
        # What else such a document holds is innocent where nothing speaks against it; of a document without a suspect
        # nothing is known.
        found = np.zeros(len(bags), bool)
        found[bag[suspect]] = True
        rest = (label >= 0) & ~suspect & found[bag] & (scores.max(1) < SUSPECTED)
        innocent = (label < 0) & (scores.max(1) < SURE)
        return np.where(suspect[:, None], y_label, 0), np.where(suspect | innocent, 1, np.where(rest, REST_WEIGHT, 0))

    first = start.score(rows)
    # Of a document's sentences one is to blame.
    share = 1 / np.bincount(bag, minlength=len(bags))[bag]
    innocent = (label < 0) & (first.max(1) < SURE)
    seen = judged(y_label, np.where(label >= 0, np.minimum(1, 3 * share), innocent))
    scores = judged(*blamed((np.sqrt(seen * first) + seen) / 2))
    y, weight = blamed(scores)
    machine = fitted(y, weight, EPOCHS)
    # The seed holds far more of such language than texts do, which tells where it is most of what was read.
    machine.bias -= SEED_PRIOR * len(from_seed) / (len(from_seed) + int((weight > 0).sum()))
    return Model(machine, lex)


def held_out(labelled: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(label, documents, found) over all labelled documents, each scored by a model that has not seen it: for a kind
    how many are found to hold it, for ok how many are found to hold anything. Wrong labels count as misses."""
    out = {k: [0, 0] for k in ("ok", *KINDS)}
    for part in (0, 1):
        model = train(labelled[1 - part :: 2])
        rest = labelled[part::2]
        for (_, k), s in zip(rest, model.document_scores([t for t, _ in rest]), strict=True):
            out[k][0] += 1
            out[k][1] += bool((s.max() if k == "ok" else s[KINDS.index(k)]) >= THRESHOLD)
    return [(k, *v) for k, v in out.items()]
