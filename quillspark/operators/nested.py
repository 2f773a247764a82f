"""Deeply nested token trees as flat, related tables.

Every JSON value of a tree is classified by a bottom-up tree automaton: a leaf's state follows
from its form, an inner value's state from its own fields and the states of its parts. The
state is the value's structural variant and decides which typed table its row goes to; every
row, of whatever table, also stands in the common ``nodes`` table with its key, its parent's
key and its place among the parent's children.

Defined results: a null or ill-formed record, or one whose root is no token, counts as not
there, and the latest of the others stands for the page (a null time is earliest, equal times
go to the larger checksum); a null child is no child; a single value where a list is expected
is one child; a text without its text is an empty text; an object that is neither text nor
token is an ``opaque`` leaf; a tree of any depth is read; fields that no table has a column
for are kept as JSON in ``other``; columns besides page_id, ast and loaded_at are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys under which children stand, in order of preference.
CHILD_KEYS = ("children", "childNodes")
#: Rows of one Arrow batch that the flattener hands on; bounds memory for one huge tree.
BATCH_ROWS = 20_000

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")


def _deep_loads(s: str) -> Any:
    """JSON of any depth, read with a stack of open containers in place of recursion."""
    root: list[Any] = []
    stack: list[Any] = []
    keys: list[str | None] = []
    i, n = _SPACE.match(s, 0).end(), len(s)

    def put(v: Any) -> None:
        if not stack:
            root.append(v)
        elif isinstance(stack[-1], list):
            stack[-1].append(v)
        else:
            stack[-1][keys[-1]] = v

    def key(i: int) -> int:
        if i >= n or s[i] != '"':
            raise ValueError("key expected")
        keys[-1], i = json.decoder.scanstring(s, i + 1, True)
        i = _SPACE.match(s, i).end()
        if i >= n or s[i] != ":":
            raise ValueError("colon expected")
        return _SPACE.match(s, i + 1).end()

    while True:
        if i >= n:
            raise ValueError("value expected")
        c, closed = s[i], True
        if c in "{[":
            v: Any = {} if c == "{" else []
            put(v)
            stack.append(v)
            keys.append(None)
            i = _SPACE.match(s, i + 1).end()
            if i < n and s[i] == ("}" if c == "{" else "]"):
                pass
            else:
                if c == "{":
                    i = key(i)
                continue
        elif c == '"':
            v, i = json.decoder.scanstring(s, i + 1, True)
            put(v)
            closed = False
        else:
            m = _ATOM.match(s, i)
            if not m:
                raise ValueError("value expected")
            put(json.loads(m[0]))
            i, closed = m.end(), False
        while True:
            if closed:
                stack.pop()
                keys.pop()
                i += 1
            i = _SPACE.match(s, i).end()
            if not stack:
                if i != n:
                    raise ValueError("trailing data")
                return root[0]
            if i >= n:
                raise ValueError("open container")
            if s[i] == ",":
                i = _SPACE.match(s, i + 1).end()
                if isinstance(stack[-1], dict):
                    i = key(i)
                break
            if s[i] != ("}" if isinstance(stack[-1], dict) else "]"):
                raise ValueError("comma or end expected")
            closed = True


def _no_constant(x: str) -> Any:
    raise ValueError(x)


def read_tree(s: str | None) -> dict | None:
    """The root token of a record, or None if it is null, ill-formed or no token."""
    if not s:
        return None
    try:
        v = json.loads(s, parse_constant=_no_constant)
    except RecursionError:
        try:
            v = _deep_loads(s)
        except ValueError:
            return None
    except ValueError:
        return None
    if isinstance(v, dict) and "type" not in v and isinstance(v.get("token"), dict):
        v = v["token"]
    return v if isinstance(v, dict) and isinstance(v.get("type"), str) else None


# ---- the automaton ------------------------------------------------------------------------

# Forms of a value, read off the value alone: the letters that the automaton reads.
TEXT, WRAPPED_TEXT, OPAQUE, TOKEN, WRAPPED_TOKEN = "text", "wrapped_text", "opaque", "token", "wrapped_token"
#: Classes of tokens by the optional fields they carry, first match; else by whether they have a name.
TOKEN_CLASSES = (("markup_tag", ("orig_tag",)), ("style", ("bold", "italic")), ("heading", ("level",)), ("closable", ("closed", "closing", "self_closing")))
#: What the states of its children make of a token: texts only, tokens only, both, something opaque among them.
_TEXT_BIT, _TOKEN_BIT, _OPAQUE_BIT = 1, 2, 4
CONTENTS = ("empty", "text", "tokens", "mixed", "odd", "odd", "odd", "odd")


@dataclass(frozen=True)
class State:
    """A structural variant: the value's form or a token's class and content, the table it goes to, and what it is to its parent."""

    variant: str
    table: str
    bit: int


def _transitions() -> dict[tuple[str, int], State]:
    """(form or class, states of the children as bits) to the state."""
    out = {(f, 0): State(f, "opaque" if f == OPAQUE else "text", _OPAQUE_BIT if f == OPAQUE else _TEXT_BIT) for f in (TEXT, WRAPPED_TEXT, OPAQUE)}
    for name in (*[n for n, _ in TOKEN_CLASSES], "named", "plain"):
        for bits, content in enumerate(CONTENTS):
            # Tokens without payload are told apart by what they hold.
            holds = content in ("tokens", "mixed", "odd")
            table = {"named": "container" if holds else "labelled", "plain": "group" if holds else "leaf"}.get(name, name)
            out[name, bits] = State(f"{name}:{content}", table, _TOKEN_BIT)
    return out


TRANSITIONS = _transitions()
TABLES = tuple(sorted({s.table for s in TRANSITIONS.values()}))


def form_of(v: Any) -> str | None:
    """The form of a child value; None for a null, which is no child."""
    if isinstance(v, str):
        return TEXT
    if v is None:
        return None
    if not isinstance(v, dict):
        return OPAQUE
    if isinstance(v.get("type"), str):
        return WRAPPED_TEXT if v["type"] == "text" and not any(k in v for k in CHILD_KEYS) else TOKEN
    if isinstance(v.get("token"), dict) and not v.get("is_text"):
        return WRAPPED_TOKEN
    if v.get("is_text") or isinstance(v.get("text"), str) or not v:
        return WRAPPED_TEXT
    return OPAQUE


def class_of(token: dict) -> str:
    for name, keys in TOKEN_CLASSES:
        for k in keys:
            if token.get(k) is not None:
                return name
    return "named" if token.get("name") else "plain"


def _kids(token: dict) -> list[Any]:
    for k in CHILD_KEYS:
        v = token.get(k)
        if v is not None:
            return v if isinstance(v, list) else [v]
    return []


NODE_DDL = (
    "page_id bigint, node_id int, parent_id int, child_ix int, depth int, variant string, typed_table string, shape string, "
    "type string, name string, text string, level int, closed boolean, self_closing boolean, closing boolean, orig_tag string, bold boolean, italic boolean, other map<string, string>"
)
COLUMNS = tuple(x.split()[0] for x in re.sub(r"<[^>]*>", "", NODE_DDL).split(", "))
#: Fields of a token that have a column, or hold its children.
_KNOWN = frozenset((*COLUMNS, *CHILD_KEYS, "is_text", "token"))
_BOOLEANS = ("closed", "self_closing", "closing", "bold", "italic")


@lru_cache(maxsize=1 << 12)
def _shape(keys: tuple[str, ...]) -> str:
    return ",".join(sorted(keys))


class Flat:
    """The nodes of one tree in document order: their values, links and states; no recursion."""

    __slots__ = ("values", "parent", "place", "depth", "states")

    def __init__(self, root: dict) -> None:
        self.values: list[Any] = []
        self.parent: list[int] = []
        self.place: list[int] = []
        self.depth: list[int] = []
        letters: list[str] = []
        stack: list[tuple[Any, str, int, int, int]] = [(root, TOKEN, -1, 0, 0)]
        while stack:
            v, form, parent, ix, depth = stack.pop()
            if form == WRAPPED_TOKEN:
                v = v["token"]
                form = TOKEN
            if form == TOKEN:
                node, kids = len(self.values), []
                for k in _kids(v):
                    if (f := form_of(k)) is not None:
                        kids.append((k, f, node, len(kids), depth + 1))
                kids.reverse()
                stack += kids
                form = class_of(v)
            self.values.append(v)
            self.parent.append(parent)
            self.place.append(ix)
            self.depth.append(depth)
            letters.append(form)
        # Children stand behind their parents, so backwards every part's state is known before the whole's.
        below = [0] * (len(letters) + 1)
        self.states: list[State] = [None] * len(letters)  # type: ignore[list-item]
        for i in range(len(letters) - 1, -1, -1):
            s = self.states[i] = TRANSITIONS[letters[i], below[i]]
            below[self.parent[i]] |= s.bit

    def __len__(self) -> int:
        return len(self.values)

    def column(self, name: str) -> list[Any]:
        """One column of NODE_DDL for all nodes."""
        match name:
            case "node_id":
                return list(range(len(self.values)))
            case "parent_id":
                return self.parent
            case "child_ix":
                return self.place
            case "depth":
                return self.depth
            case "variant":
                return [s.variant for s in self.states]
            case "typed_table":
                return [s.table for s in self.states]
            case "text":
                return [self._text(v) if s.bit == _TEXT_BIT else None for v, s in zip(self.values, self.states, strict=True)]
            case "shape":
                return [_shape(tuple([k for k, x in v.items() if x is not None])) if isinstance(v, dict) else "" for v in self.values]
            case "other":
                return [self._other(v) if s.bit == _TOKEN_BIT else None for v, s in zip(self.values, self.states, strict=True)]
        kind = bool if name in _BOOLEANS else int if name == "level" else str
        out = [_typed(v.get(name), kind) if s.bit == _TOKEN_BIT else None for v, s in zip(self.values, self.states, strict=True)]
        return [x or None for x in out] if name == "name" else out

    @staticmethod
    def _text(v: Any) -> str:
        t = v if isinstance(v, str) else v.get("text")
        return t if isinstance(t, str) else ""

    @staticmethod
    def _other(v: dict) -> list[tuple[str, str]] | None:
        return [(k, json.dumps(x, ensure_ascii=False)) for k, x in v.items() if k not in _KNOWN and x is not None] or None


def _typed(v: Any, kind: type) -> Any:
    return v if isinstance(v, kind) and not (kind is int and isinstance(v, bool)) else None


def latest_trees(trees: DataFrame) -> DataFrame:
    """(page_id, ast): the latest well-formed record of each page."""

    @F.pandas_udf("boolean")
    def well_formed(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: read_tree(x) is not None).astype(bool)

    ok = trees.select("page_id", "ast", F.coalesce(F.col("loaded_at").cast("timestamp").cast("double"), F.lit(float("-inf"))).alias("_v")).filter(F.col("ast").isNotNull())
    ok = ok.filter(well_formed("ast"))
    # Copies of a hot page meet as partial maxima, one per task.
    return ok.groupBy("page_id").agg(F.max_by("ast", F.struct("_v", F.xxhash64("ast"))).alias("ast"))


def flatten_trees(trees: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The common table of all nodes of the latest well-formed tree per page; of NODE_DDL's columns those asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema

    node_schema = T.StructType([f for f in T.StructType.fromDDL(NODE_DDL) if f.name in columns])
    schema = to_arrow_schema(node_schema)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in schema.names}

        def batch(n: int) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held[f.name][:n], f.type) for f in schema], schema=schema)
            for f in schema:
                del held[f.name][:n]
            return out

        for b in batches:
            for page, ast in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tree = Flat(read_tree(ast.as_py()))
                for name, column in held.items():
                    column += [page] * len(tree) if name == "page_id" else tree.column(name)
                while len(held[schema.names[0]]) >= BATCH_ROWS:
                    yield batch(BATCH_ROWS)
        if held[schema.names[0]]:
            yield batch(len(held[schema.names[0]]))

    return latest_trees(trees).mapInArrow(flat, node_schema)


#: Columns of the typed tables besides the common key, parent link and place.
TABLE_COLUMNS = {
    "text": ["text"], "opaque": ["shape"], "markup_tag": ["type", "name", "orig_tag", "closing", "self_closing", "other"], "style": ["type", "name", "bold", "italic", "other"], "heading": ["type", "name", "level", "other"],
    "closable": ["type", "name", "closed", "closing", "self_closing", "other"], "labelled": ["type", "name", "other"], "container": ["type", "name", "other"], "leaf": ["type", "other"], "group": ["type", "other"],
}
KEY = ["page_id", "node_id", "parent_id", "child_ix"]


def typed_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of a ``nodes`` table; each keeps the common key, parent link, place and variant."""
    return {name: nodes.filter(F.col("typed_table") == name).select(*KEY, "variant", *TABLE_COLUMNS[name]) for name in TABLES if set(TABLE_COLUMNS[name]) <= set(nodes.columns)}


def names_table(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, name) of all tokens that have a name."""
    return nodes.filter(F.col("name").isNotNull()).select("page_id", "node_id", "name")
