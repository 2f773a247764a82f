"""Evaluation of trees and runs: differences, schema rules, latency statistics, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles under which each role may stand, where it may stand under few; others are free.
ALLOWED_PARENTS = {
    "heading-title": ("heading",), "heading-trail": ("heading",), "link-target": ("link", "file", "category", "redirect-target", "gallery-image", "imagemap-image", "ext-inner"), "link-text": ("link", "category", "redirect-target"),
    "template-name": ("template",), "magic-word-name": ("magic-word",), "parameter": ("template", "magic-word"), "parameter-key": ("parameter",), "parameter-value": ("parameter",), "arg-name": ("arg",), "arg-default": ("arg",), "hidden": ("arg",),
    "tr": ("table",), "td": ("table", "tr"), "td-inner": ("td",), "table-syntax": ("table", "tr", "td"), "table-attrs": ("table", "tr", "td"), "table-attr": ("table-attrs",), "ext-attrs": ("ext",), "ext-inner": ("ext",), "ext-attr": ("ext-attrs",),
    "html-attrs": ("html",), "html-attr": ("html-attrs",), "attr-key": ("ext-attr", "html-attr", "table-attr"), "attr-value": ("ext-attr", "html-attr", "table-attr"), "image-parameter": ("file", "gallery-image", "imagemap-image"),
    "ext-link-url": ("ext-link",), "ext-link-text": ("ext-link",), "redirect-target": ("redirect",), "redirect-syntax": ("redirect",), "invoke-module": ("magic-word",), "invoke-function": ("magic-word",),
    "ext-attr-dirty": ("ext-attrs",), "html-attr-dirty": ("html-attrs",), "table-attr-dirty": ("table-attrs",), "table-inter": ("table", "tr"), "param-line": ("ext-inner",), "imagemap-link": ("ext-inner",),
    "gallery-image": ("ext-inner",), "imagemap-image": ("ext-inner",), "converter-flags": ("converter",), "converter-flag": ("converter-flags",), "converter-rule": ("converter",), "converter-rule-from": ("converter-rule",), "converter-rule-variant": ("converter-rule",), "converter-rule-to": ("converter-rule",),
}


def schema_violations(t: DataFrame) -> DataFrame:
    """(page_id, node_id, problem): nodes under a parent of the wrong role, and broken tree links."""
    parents = t.filter(F.col("kind") == "token").select("page_id", F.col("node_id").alias("parent_id"), F.col("subtype").alias("_ps"), F.col("subtree_end").alias("_pe"))
    rules = F.create_map(*[x for k, v in ALLOWED_PARENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    j = t.join(parents, ["page_id", "parent_id"], "left")
    root = F.col("parent_id").isNull()
    problem = (
        F.when(root & (F.col("node_id") != 0), "second root").when(~root & F.col("_ps").isNull(), "missing parent")
        .when(~root & (F.col("subtree_end") > F.col("_pe")), "interval").when(rules[F.col("subtype")].isNotNull() & ~F.coalesce(F.array_contains(rules[F.col("subtype")], F.col("_ps")), F.lit(False)), "parent role")
    )
    return j.select("page_id", "node_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def _plain_payload(df: DataFrame, side: str) -> Column:
    """The payload as JSON without what is empty or false, as these equal what is missing."""
    fields = df.schema["payload"].dataType.fields
    plain = {"string": lambda c: F.nullif(c, F.lit("")), "boolean": lambda c: F.nullif(c, F.lit(False))}
    text = F.to_json(F.struct(*[plain.get(f.dataType.simpleString(), lambda c: c)(F.col(f"{side}.payload.{f.name}")).alias(f.name) for f in fields]))
    return F.coalesce(text, F.lit("{}"))


def _same(c: str, a: str, b: str) -> Column:
    # Empty, false and missing are one value.
    norm = lambda side: F.nullif(F.nullif(F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("")), F.lit("false")), F.lit(""))
    return norm(a).eqNullSafe(norm(b))


def ast_diff(got: DataFrame, want: DataFrame) -> DataFrame:
    """(page_id, node_id, field): where two token tables of the same pages differ, node by node."""
    on = ["page_id", "node_id"]
    j = got.alias("g").join(want.alias("w"), on, "full")
    fields = ["type", "subtype", "name", "text", "child_ix", "parent_id"]
    flags = [F.when(~_same(f, "g", "w"), F.lit(f)) for f in fields]
    flags.append(F.when(_plain_payload(got, "g") != _plain_payload(want, "w"), F.lit("payload")))
    where = F.when(F.col("w.type").isNull(), F.array(F.lit("only_got"))).when(F.col("g.type").isNull(), F.array(F.lit("only_want"))).otherwise(F.array_compact(F.array(*flags)))
    return j.select(*on, F.explode(where).alias("field"))


def smallest_difference(diff: DataFrame, t: DataFrame) -> DataFrame:
    """(page_id, node_id, field): per page the deepest first node that differs, the smallest slice to look at."""
    d = diff.join(t.select("page_id", "node_id", "depth"), ["page_id", "node_id"])
    return d.groupBy("page_id").agg(F.max_by(F.struct("node_id", "field"), F.struct("depth", -F.col("node_id"))).alias("x")).select("page_id", "x.node_id", "x.field")


def snapshot_diff(got: DataFrame, want: DataFrame) -> DataFrame:
    """(page_id, stage): the first stage of each page after which two runs' snapshots differ or one is missing."""
    j = got.alias("g").join(want.alias("w"), ["page_id", "stage"], "full").filter(~F.col("g.snapshot").eqNullSafe(F.col("w.snapshot")))
    return j.groupBy("page_id").agg(F.min("stage").alias("stage"))


def parity(got: DataFrame, want: DataFrame) -> DataFrame:
    """(page_id, text_equal): whether two (page_id, text) tables agree; a page on one side only is unequal."""
    j = got.alias("g").join(want.alias("w"), "page_id", "full")
    return j.select("page_id", (F.col("g.text").isNotNull() & F.col("g.text").eqNullSafe(F.col("w.text"))).alias("text_equal"))


def failure_records(got: DataFrame, source: DataFrame, other: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per page that fails: whether another parser's text is the same, whether the tree keeps the schema's
    rules, whether the source comes back, both lengths and the broken rules; texts are (page_id, text)."""
    broken = violations.groupBy("page_id").agg(F.array_sort(F.collect_set("problem")).alias("schema_errors"))
    j = source.alias("s").join(got.alias("g"), "page_id", "left").join(other.alias("o"), "page_id", "left").join(broken, "page_id", "left")
    rows = j.select(
        "page_id", F.col("g.text").eqNullSafe(F.col("o.text")).alias("parity_ok"), F.col("schema_errors").isNull().alias("schema_ok"), F.col("g.text").eqNullSafe(F.col("s.text")).alias("round_trip_ok"),
        F.length("g.text").alias("got_len"), F.length("s.text").alias("want_len"), F.coalesce("schema_errors", F.array().cast("array<string>")).alias("schema_errors"),
    )
    return rows.filter(~(F.col("parity_ok") & F.col("schema_ok") & F.col("round_trip_ok")))


def latency_stats(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, min, max, mean, population deviation and interpolated percentiles."""
    v = F.col(value).cast("double")
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), p.alias("_p"))
    return out.select(*by, "n", "min", "max", "mean", "sd", *[F.round(F.col("_p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def slow_samples(samples: DataFrame, first: str, second: str, floor: float = 100.0, factor: float = 2.0) -> DataFrame:
    """Samples whose second time is above the floor and, ``factor`` times, above the first."""
    return samples.filter((F.col(second) > floor) & (F.col(second) * factor > F.col(first)))


def speedup(samples: DataFrame, first: str, second: str) -> DataFrame:
    a, b = F.avg(first), F.avg(second)
    return samples.agg(F.round(a / b, 6).alias("speedup"), F.round((b - a) / a * 100, 6).alias("change_percent"))


def profile_diff(profile: DataFrame, run_a: str, run_b: str, top: int = 20) -> DataFrame:
    """Leaf shares of two runs and their difference, the largest first; profile: (run, leaf, cnt)."""
    s = profile.filter(F.col("run").isin(run_a, run_b)).groupBy("leaf").agg(*[F.sum(F.when(F.col("run") == r, F.col("cnt")).otherwise(0)).alias(n) for r, n in ((run_a, "a"), (run_b, "b"))])
    # One row of totals.
    ta, tb = s.agg(F.sum("a"), F.sum("b")).first()
    out = s.select("leaf", F.round(F.col("a") * 100 / F.lit(ta or None), 4).alias("share_a"), F.round(F.col("b") * 100 / F.lit(tb or None), 4).alias("share_b"))
    return out.withColumn("delta", F.round(F.col("share_b") - F.col("share_a"), 4)).orderBy(F.abs("delta").desc(), "leaf").limit(top)


def run_summary(pages: DataFrame, failures: DataFrame, name: str) -> DataFrame:
    """(input, processed, failures, ok): one row for a corpus run."""
    both = pages.select(F.lit(1).alias("p"), F.lit(0).alias("f")).unionByName(failures.select(F.lit(0).alias("p"), F.lit(1).alias("f")))
    n = both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("processed"), F.coalesce(F.sum("f"), F.lit(0)).alias("failures"))
    return n.select(F.lit(name).alias("input"), "processed", "failures", (F.col("failures") == 0).alias("ok"))


def top_per_group(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(value).desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
