"""Exact title functions as Arrow-batched Python: all escapes, relative titles, validity."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.kernel import title as _title
from quillspark.kernel.config import SiteConfig, default

TITLE_DDL = "main string, ns int, prefix string, fragment string, interwiki string, title string, valid boolean"


def parse_title(c: Column, default_ns: int = 0, page: Column | None = None, config: SiteConfig | None = None) -> Column:
    """struct of TITLE_DDL; a null title gives an invalid empty one."""
    config = config or default()

    @F.pandas_udf(TITLE_DDL)
    def run(raw: pd.Series, on: pd.Series) -> pd.DataFrame:
        rows = [_title.parse_title(r or "", config, default_ns, p) for r, p in zip(raw, on, strict=True)]
        return pd.DataFrame([(t.main, t.ns, t.prefix, t.fragment, t.interwiki, t.title, t.valid) for t in rows], columns=["main", "ns", "prefix", "fragment", "interwiki", "title", "valid"])

    return run(c, page if page is not None else F.lit(None).cast("string"))


def _by_value(c: Column, f: Callable[[str], str]) -> Column:
    # Built here, as a function of this kind needs a running session.
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run(c)


def decode_entities(c: Column) -> Column:
    """Numeric and basic named entities."""
    return _by_value(c, _title.decode_entities)


def decode_percent(c: Column) -> Column:
    """Valid percent escapes; plus signs and malformed ones stay."""
    return _by_value(c, _title.decode_percent)


def normalize(c: Column) -> Column:
    return _by_value(c, _title.normalize)
