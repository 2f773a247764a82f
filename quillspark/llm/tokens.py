"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from quillspark.llm.arrow import map_rows, spread

#: Place of the vocabulary file; a parameter of every operator that counts tokens.
TOKENIZER = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern's look-ahead fails on blanks of about a million; runs from this length on are taken out of its way.
LONG_BLANKS = 100_000
_BLANKS = re.compile(r"\s{%d,}" % LONG_BLANKS)
_ENCODINGS: dict[str, object] = {}


def size(enc, text: str) -> int:  # noqa: ANN001
    """Tokens of a text, exactly those of the encoder: by the pattern a run of blanks is one piece up to its last
    blank, which goes with what follows."""
    n = at = 0
    for m in _BLANKS.finditer(text) if len(text) >= LONG_BLANKS else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def counter(path: str = TOKENIZER) -> Callable[[str | None], int]:
    """A function that counts the tokens of a text; null and empty texts have none."""
    import tiktoken

    enc = _ENCODINGS.get(path)
    if enc is None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: size(enc, t) if t else 0


def with_token_counts(df: DataFrame, keep: dict[str, str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` (name to type) of every row, with ``tokens``, the size of its text; spreads the rows."""

    def make() -> Callable[..., Iterator[tuple]]:
        count = counter(path)
        return lambda *v: iter([(*v[:-1], count(v[-1]))])

    ddl = ", ".join(f"`{k}` {t}" for k, t in keep.items()) + ", tokens bigint"
    return map_rows(spread(df.select(*keep, text)), make, ddl)
