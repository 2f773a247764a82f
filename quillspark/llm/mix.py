"""Mixing sources to target weights.

For each mix, the tokens to draw from every cell of source, language and topic are found by
iterative proportional fitting: the cells' tokens are raked in turn to the target per source
(from the weights) and to the shares of languages and topics that these sources have by
nature, never above a cell's tokens times the cap on repeats. A cell's tokens to draw over its
tokens at hand is its rate: its whole part is how often each of its documents is taken, its
fraction the probability of one time more. The fractional draws are made by sequential Poisson
sampling per source: documents in the order of a hashed random number over their probability,
up to the source's budget of tokens. Tokens are summed up in steps of that order first, so only
the step in which the budget ends is put in order.

Defined results: sources are compared without case, blanks and the difference of ``_`` and
``-``; a source without documents, with a null weight or a weight of 0 draws nothing and what
it lacks goes to the other sources by their weights; so does what a capped source lacks; a
null cap is no cap; documents without tokens are never drawn; repeated rows are separate
documents; a mix whose sources have no documents draws nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut

# Languages and title prefixes that make up their own margins.
LANGUAGES = ("en", "de", "fr", "es")
TOPICS = ("talk", "help", "template", "project", "category", "file", "user")
RAKING_STEPS = 200
#: The order of draws is cut into steps of about this many documents of all sources together.
STEP_ROWS = 200_000


def plain_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_\\s]+", "-")


def language(c: Column) -> Column:
    short = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2})(?:-|$)", 1)
    return F.when(short.isin(*LANGUAGES), short).otherwise("other")


def topic(c: Column) -> Column:
    prefix = F.lower(F.regexp_extract(c, "^([A-Za-z]+):", 1))
    return F.when(prefix.isin(*TOPICS), prefix).otherwise("article")


def source_targets(weights: dict[str, float], caps: dict[str, float | None], at_hand: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: in proportion to the weights, where a source's cap lets it; the rest goes to the others."""
    open_, out, left = {s for s, w in weights.items() if w and w > 0 and at_hand.get(s, 0) > 0}, dict.fromkeys(weights, 0.0), total
    while open_ and left > 1e-9:
        scale = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if caps.get(s) is not None and scale * weights[s] >= caps[s] * at_hand[s]}
        if not full:
            for s in open_:
                out[s] = scale * weights[s]
            break
        for s in full:
            out[s] = float(caps[s] * at_hand[s])
            left -= out[s]
        open_ -= full
    return out


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, float], caps: dict[str, float | None]) -> np.ndarray:
    """Tokens to draw per cell (source, language, topic, tokens), by iterative proportional fitting within the caps."""
    have = np.array([c[3] for c in cells], float)
    most = np.array([np.inf if caps.get(c[0]) is None else caps[c[0]] * c[3] for c in cells])
    start = have * np.array([targets.get(c[0], 0.0) > 0 for c in cells])
    x, total = start.copy(), sum(targets.values())
    if not start.sum() or not total:
        return np.zeros(len(cells))
    axes = [np.unique([c[k] for c in cells], return_inverse=True) for k in range(3)]
    margins = [np.array([targets.get(n, 0.0) for n in axes[0][0]])]
    margins += [np.bincount(ix, start, len(names)) * total / start.sum() for names, ix in axes[1:]]
    for _ in range(RAKING_STEPS):
        # Sources last: theirs is the margin that is promised.
        for k in (1, 2, 0, 0, 0):
            now = np.bincount(axes[k][1], x, len(axes[k][0]))
            x = np.minimum(x * (margins[k] / np.maximum(now, 1e-12))[axes[k][1]], most)
    return x


def mix_rates(cells: list[tuple[str, str, str, float]], mixtures: list[tuple[str, str, float, int | None, float]], all_tokens: float) -> list[tuple[str, str, str, str, int, float, float]]:
    """(mix, source, lang, topic, times, chance, budget) for every cell of every mix; budget: the source's tokens for the draws by chance."""
    out = []
    for mix in sorted({m[0] for m in mixtures if m[0] is not None}):
        rows = [m for m in mixtures if m[0] == mix and m[1] is not None]
        weights = {m[1]: float(m[2] or 0) for m in rows}
        caps = {m[1]: None if m[3] is None else float(max(0, m[3])) for m in rows}
        own = [c for c in cells if c[0] in weights]
        at_hand: dict[str, float] = {}
        for c in own:
            at_hand[c[0]] = at_hand.get(c[0], 0) + c[3]
        total = all_tokens * max((float(m[4] or 0) for m in rows), default=0.0)
        x = rake(own, source_targets(weights, caps, at_hand, total), caps) if own else np.zeros(0)
        rate = x / np.maximum([c[3] for c in own], 1e-12) if own else x
        times = np.floor(rate + 1e-9)
        chance = np.clip(rate - times, 0, 1)
        chance[chance < 1e-9] = 0
        budget: dict[str, float] = {}
        for c, f in zip(own, chance, strict=True):
            budget[c[0]] = budget.get(c[0], 0) + f * c[3]
        out += [(mix, c[0], c[1], c[2], int(t), float(f), float(budget[c[0]])) for c, t, f in zip(own, times, chance, strict=True) if c[3] > 0]
    return out


def draw(documents: DataFrame, mixtures: DataFrame, count_tokens) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(mix_name, doc_id, source, tokens, repeats) of the documents drawn, and the sized documents they are from."""
    spark = documents.sparkSession
    named = documents.select("doc_id", plain_source(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), topic(F.col("title")).alias("topic"), "text")
    sized = cut(count_tokens(named))
    wanted = [(r[0], r[1], r[2], r[3], r[4]) for r in mixtures.select("mix_name", plain_source(F.col("source")), F.col("weight").cast("double"), "max_repeats", F.col("size_factor").cast("double")).collect()]
    sources = sorted({m[1] for m in wanted if m[1]})
    # Cells: sources of the mixes x languages x topics, a few hundred rows at most.
    cells = [(r[0], r[1], r[2], float(r[3])) for r in sized.filter(F.col("source").isin(*sources)).groupBy("source", "lang", "topic").agg(F.sum("tokens")).collect()]
    all_tokens, rows = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    rates = mix_rates(sorted(cells), wanted, float(all_tokens))
    table = spark.createDataFrame(rates or [("", "", "", "", 0, 0.0, 0.0)], "mix_name string, source string, lang string, topic string, times int, chance double, budget double")
    each = sized.filter("tokens > 0").join(F.broadcast(table), ["source", "lang", "topic"])
    uniform = (F.xxhash64("mix_name", "doc_id", "tokens").cast("double") / F.lit(2.0**64)) + 0.5
    each = each.withColumn("_x", F.when(F.col("chance") > 0, uniform / F.col("chance")))
    more = F.coalesce(F.col("_more"), F.lit(0))
    drawn = by_chance(each, max(1, int(rows) // STEP_ROWS)).select("mix_name", "doc_id", "source", "tokens", (F.col("times") + more).cast("int").alias("repeats")).filter("repeats > 0")
    return drawn, sized


def budget_steps(each: DataFrame) -> DataFrame:
    """(mix_name, source, _edge, _ahead): the step of each source in which its budget ends, and the tokens of the steps ahead of it."""
    sums = each.filter("_g is not null").groupBy("mix_name", "source", "_g").agg(F.sum("tokens").alias("_t"), F.first("budget").alias("_budget"))
    ahead = F.sum("_t").over(Window.partitionBy("mix_name", "source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_o", F.coalesce(ahead, F.lit(0)))
    return sums.filter((F.col("_o") < F.col("_budget")) & (F.col("_o") + F.col("_t") > F.col("_budget"))).select("mix_name", "source", F.col("_g").alias("_edge"), F.col("_o").alias("_ahead"))


def by_chance(each: DataFrame, steps: int) -> DataFrame:
    """``each`` with _more: 1 for the documents drawn once more. Steps wholly within a source's budget are drawn, those
    behind it are not, and a window goes over the one step between, whatever share of all documents a source holds."""
    # Steps of a logarithm are fine where budgets end, near 1, and do not pile up what lies far behind.
    each = each.withColumn("_g", F.floor(F.log2(F.col("_x") + 1) * steps))
    # One row per mix and source at most.
    each = each.join(F.broadcast(budget_steps(each)), ["mix_name", "source"], "left")
    edge = F.coalesce(F.col("_g") == F.col("_edge"), F.lit(False))
    fits = F.when(F.col("_g").isNotNull() & (F.col("_edge").isNull() | (F.col("_g") < F.col("_edge"))) & (F.col("budget") > 0), 1).otherwise(0)
    order = Window.partitionBy("mix_name", "source").orderBy("_x", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    here = each.filter(edge).withColumn("_b", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    here = here.withColumn("_more", ((F.col("_b") + F.col("_ahead") + F.col("tokens") / 2) <= F.col("budget")).cast("int")).drop("_b")
    return each.filter(~edge).withColumn("_more", fits).unionByName(here)


def shares(drawn: DataFrame, sized: DataFrame, mixtures: DataFrame) -> DataFrame:
    """Per mix and source: the weight's share, the share reached, tokens drawn and at hand, the most repeats."""
    want = mixtures.select("mix_name", plain_source(F.col("source")).alias("source"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), "max_repeats")
    want = want.groupBy("mix_name", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    per_mix = want.groupBy("mix_name").agg(F.sum("weight").alias("_w"))
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("drawn_documents"))
    totals = got.groupBy("mix_name").agg(F.sum("drawn_tokens").alias("_t"))
    hand = sized.groupBy("source").agg(F.sum("tokens").alias("tokens_at_hand"))
    out = want.join(per_mix, "mix_name").join(got, ["mix_name", "source"], "left").join(totals, "mix_name", "left").join(hand, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "mix_name", "source", F.round(F.col("weight") / F.col("_w"), 4).alias("target_share"), F.round(F.coalesce(F.col("drawn_tokens") / F.col("_t"), F.lit(0.0)), 4).alias("actual_share"),
        zero("drawn_tokens"), zero("drawn_documents"), zero("tokens_at_hand"), zero("most_repeats"), "max_repeats",
    )
