"""Filling containers of fixed capacity with items of varying length.

Items meet containers only through the histogram of lengths, which has at most ``capacity``
rows however many items there are. Over it, combinations of few distinct lengths that fill a
window below the capacity are enumerated, non-negative least squares gives how often each
should be used, the numbers are rounded down, and what is left is packed greedily, largest
first, again on the histogram. Items then find their container by their rank among the items
of their length.

Defined results: an item above the capacity is divided into full pieces and a rest, no other
item is; items of length 0 or null length need no room and have a null container; repeated
rows are separate items; an empty table gives an empty assignment.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut

#: Combinations fill at least this share of the capacity.
FILL_WINDOW = 0.995
#: Second lengths tried with each first one, and combinations kept of them.
PARTNERS, KEPT = 48, 6
NNLS_STEPS = 400
#: Items of one length are ranked in groups of about this many rows.
RANK_ROWS = 500_000


@dataclass(frozen=True)
class Pattern:
    """A container's contents, length to number of items, and how many containers have them."""

    contents: tuple[tuple[int, int], ...]
    repeats: int


def combinations(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of up to three distinct lengths that fill the window below the capacity."""
    lengths = sorted(hist)
    weight = np.cumsum([hist[x] for x in lengths])
    quantiles = np.linspace(0, weight[-1], PARTNERS + 2)[1:-1]
    partners = sorted({lengths[int(i)] for i in np.searchsorted(weight, quantiles)}, reverse=True)
    least = FILL_WINDOW * capacity
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for first in lengths:
        found: dict[tuple[tuple[int, int], ...], int] = {}
        most = min(capacity // first, hist[first])
        for a in sorted({most, max(1, most // 2), 1}, reverse=True):
            gap = capacity - a * first
            if capacity - gap >= least:
                found[((first, a),)] = gap
            for second in partners:
                b = min(gap // second, hist[second])
                if b < 1 or second == first:
                    continue
                for n in {b, max(1, b - 1)}:
                    rest = gap - n * second
                    i = bisect_right(lengths, rest) - 1
                    combo = {first: a, second: n}
                    if i >= 0:
                        combo[lengths[i]] = combo.get(lengths[i], 0) + 1
                        rest -= lengths[i]
                    if capacity - rest >= least:
                        found[tuple(sorted(combo.items()))] = rest
        for combo in sorted(found, key=lambda c: (found[c], len(c), c))[:KEPT]:
            out[combo] = found[combo]
    return list(out)


def nnls(combos: list[tuple[tuple[int, int], ...]], hist: dict[int, int], steps: int = NNLS_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' use of each length near the histogram.

    Minimises ||A x - h||^2 with multiplicative updates, which keep x non-negative; A has at
    most three entries a column and is only ever used as lists of its entries.
    """
    lengths = {x: i for i, x in enumerate(sorted(hist))}
    h = np.array([hist[x] for x in sorted(hist)], float)
    col = np.array([j for j, c in enumerate(combos) for _ in c])
    row = np.array([lengths[x] for c in combos for x, _ in c])
    val = np.array([n for c in combos for _, n in c], float)
    # Rows are weighted by 1 / sqrt(h), so that rare lengths count too.
    val = val / np.sqrt(h)[row]
    x = np.full(len(combos), h.sum() / max(1, val.sum()))
    up = np.bincount(col, val * np.sqrt(h)[row], len(combos))
    for _ in range(steps):
        ax = np.bincount(row, val * x[col], len(h))
        x *= up / np.maximum(np.bincount(col, val * ax[row], len(combos)), 1e-12)
    return x


def plan(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up the histogram exactly; lengths are from 1 to the capacity."""
    left = {x: n for x, n in hist.items() if n > 0 and 0 < x <= capacity}
    out: list[Pattern] = []
    if left and (combos := combinations(left, capacity)):
        x = nnls(combos, left)
        for j in np.argsort(-x, kind="stable"):
            n = min(int(x[j]), *(left[length] // k for length, k in combos[j]))
            if n > 0:
                out.append(Pattern(combos[j], n))
                for length, k in combos[j]:
                    left[length] -= n * k
    lengths = sorted(x for x, n in left.items() if n)
    while lengths:
        gap, contents = capacity, {}
        at = len(lengths) - 1
        while at >= 0:
            length = lengths[at]
            k = min(gap // length, left[length])
            if k:
                contents[length] = k
                gap -= k * length
            at = min(at, bisect_right(lengths, gap)) - 1
        n = min(left[length] // k for length, k in contents.items())
        out.append(Pattern(tuple(contents.items()), n))
        for length, k in contents.items():
            left[length] -= n * k
        lengths = [x for x in lengths if left[x]]
    return out


def divide(items: DataFrame, keys: list[str], size: str, capacity: int) -> DataFrame:
    """Pieces (keys, piece_ix, tokens): full pieces and the rest of items above the capacity, all others whole."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(n / capacity).cast("bigint"), F.lit(1)) - 1
    pieces = items.select(*keys, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_p"))
    return pieces.select(*keys, F.col("_p").cast("int").alias("piece_ix"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("_p") * capacity).alias("tokens"))


def assign(items: DataFrame, keys: list[str], size: str, capacity: int) -> DataFrame:
    """(keys, piece_ix, tokens, container_id) for all items, packed into containers of the capacity."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    pieces = divide(items, keys, size, capacity)
    # At most ``capacity`` rows come back, however many items there are.
    hist = {int(r[0]): int(r[1]) for r in pieces.filter("tokens > 0").groupBy("tokens").count().collect()}
    slots: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    base = 0
    for p in plan(hist, capacity):
        for length, k in p.contents:
            start = used.get(length, 0)
            slots.append((length, start, start + k * p.repeats, k, base))
            used[length] = start + k * p.repeats
        base += p.repeats
    salts = max(1, sum(hist.values()) // RANK_ROWS)
    salted = pieces.withColumn("_s", F.pmod(F.xxhash64(*keys, "piece_ix"), F.lit(salts)))
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("tokens", "_s").orderBy(*keys, "piece_ix")) - 1)
    counts = salted.groupBy("tokens", "_s").count()
    before = F.sum("count").over(Window.partitionBy("tokens").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("tokens", "_s", F.coalesce(before, F.lit(0)).alias("_o"))
    ranked = ranked.join(offsets, ["tokens", "_s"]).withColumn("_r", F.col("_k") + F.col("_o"))
    # The slots of each length in order: bounded by the histogram, not by the items.
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, a, _, k, c in sorted(slots):
        by_length.setdefault(length, []).append((a, k, c))
    table = spark.createDataFrame([(x, [s[0] for s in v], [s[1] for s in v], [s[2] for s in v]) for x, v in by_length.items()] or [(0, [0], [1], [0])], "_l bigint, _a array<bigint>, _m array<bigint>, _c array<bigint>")
    placed = ranked.join(F.broadcast(table), F.col("tokens") == F.col("_l"), "left")
    # The last slot that begins at or before the rank, found by halving.
    low = F.lit(0)
    for step in _halvings(max(map(len, by_length.values()), default=1)):
        low = F.when(F.get("_a", low + step) <= F.col("_r"), low + step).otherwise(low)
        placed = placed.withColumn("_i", low)
        low = F.col("_i")
    at = F.col("_i") if by_length else F.lit(0)
    container = F.get("_c", at) + F.floor((F.col("_r") - F.get("_a", at)) / F.get("_m", at))
    return placed.select(*keys, "piece_ix", "tokens", container.cast("bigint").alias("container_id"))


def _halvings(n: int) -> list[int]:
    """Steps of a search among n places, widest first; at least one."""
    steps = [1]
    while steps[0] * 2 < n:
        steps.insert(0, steps[0] * 2)
    return steps


def pack_documents(documents: DataFrame, limits: list[tuple[int, int]], count_tokens) -> DataFrame:  # noqa: ANN001
    """(limit_id, capacity, doc_id, piece_ix, tokens, container_id) of all documents for each (limit_id, capacity)."""
    sized = cut(count_tokens(documents))
    parts = [assign(sized, ["doc_id"], "tokens", c).select(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity"), "doc_id", "piece_ix", "tokens", "container_id") for i, c in limits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of room used per limit; pieces without tokens are in no container."""
    per = packed.groupBy("limit_id", "capacity", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.groupBy("limit_id", "capacity").agg(
        F.count("container_id").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("n").alias("pieces"),
        F.round(F.sum("t") / (F.count("container_id") * F.first("capacity")), 4).alias("fill_share"),
    )
