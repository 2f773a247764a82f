"""Views, sources and streams on small hand-made pages."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as L1
from quillspark.functions import titles
from quillspark.operators import evaluate as ev
from quillspark.operators import views as v
from quillspark.operators.parse import Engine, map_pages, stage_for
from quillspark.plans import wiki
from quillspark.sources import pages as src
from quillspark.streaming import pages as stream

PAGE = (
    "#REDIRECT [[Old#x|shown]]\n= A =\n'''b''' [[Link|text]] [[Category:C|k]] [[File:f.png|thumb|30x40px|cap]]\n"
    '== B ==\n{{t|1|k=v}} {{{arg|d}}} {{#invoke:M|f}} <ref name="n">r</ref><ref name=n />\n=== C ===\n'
    '{|\n! h\n|-\n| colspan=2 | c\n|}\n----\n__TOC__ https://a.b RFC 1 <span class="x">y</span><!-- c -->\n== D ==\n* i'
)


@pytest.fixture(scope="module")
def tokens(spark):
    df = spark.createDataFrame([(1, "P", PAGE), (2, None, None), (3, "", "")], "page_id bigint, title string, wikitext string").selectExpr("*", "'x' as node_id", "1 as type", "2 as _k")
    return Engine(spark).tokens(df).cache()


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_empty_pages_have_a_root(tokens):
    assert got(tokens.filter("page_id > 1"), "page_id", "type") == [(2, "ROOT"), (3, "ROOT")]


def test_views(tokens):
    assert got(v.redirects(tokens), "target", "display", "title") == [("Old#x", "shown", "Old")]
    assert got(v.links(tokens), "title", "text") == [("Link", "text")]
    assert got(v.categories(tokens), "title", "sort_key") == [("Category:C", "k")]
    assert got(v.files(tokens), "title", "caption", "width", "height") == [("File:F.png", "cap", "30", "40")]
    assert got(v.template_params(tokens), "call", "param_name", "value", "anon") == [("Template:T", "1", "1", True), ("Template:T", "k", "v", False)]
    assert got(v.template_args(tokens), "name", "default") == [("arg", "d")] and got(v.invocations(tokens), "module", "function") == [("M", "f")]
    assert got(v.refs(tokens), "ref_name", "number") == [("n", 1), ("n", 1)]
    assert got(v.table_cells(tokens), "kind", "text", "row_ix", "colspan") == [("td", "c", 1, 2), ("th", "h", 0, 1)]
    assert got(v.ext_links(tokens), "url", "bracketed", "protocol") == [("https://a.b", False, "https://")]
    assert got(v.identifiers(tokens), "kind", "value") == [("RFC", "1")] and got(v.html_attrs(tokens), "attr", "value") == [("class", "x")]
    assert got(v.comments(tokens), "text", "closed") == [(" c ", True)] and got(v.rules(tokens), "dashes") == [(4,)]
    assert {r.rel for r in v.edges(tokens).collect()} == {"redirectsTo", "linksTo", "hasCategory", "usesFile", "usesTemplate", "externalLink", "invokes"}


def test_section_tree(tokens):
    s = {r.title: r for r in v.sections(tokens).collect()}
    assert [s[t].ordinal for t in "ABCD"] == [1, 2, 3, 4]
    assert s["A"].parent_section is None and s["B"].parent_section == s["A"].node_id and s["C"].parent_section == s["B"].node_id and s["D"].parent_section == s["A"].node_id
    assert s["B"].end_node == s["D"].node_id - 1 and s["D"].end_node is None


def test_all_views_on_no_tokens(tokens):
    for f in v.ALL:
        assert f(tokens.limit(0)).count() == 0, f.__name__


def test_schema_and_diff(spark, tokens):
    assert ev.schema_violations(tokens).count() == 0
    assert ev.schema_violations(tokens.filter("subtype != 'heading'")).count() > 0
    assert ev.ast_diff(tokens, tokens).count() == 0
    other = tokens.withColumn("name", F.when(F.col("subtype") == "link", "X").otherwise(F.col("name")))
    diff = ev.ast_diff(tokens, other)
    assert got(diff, "page_id", "field") == [(1, "name")] and ev.smallest_difference(diff, tokens).count() == 1


def test_deterministic_over_partitions(spark):
    df = spark.createDataFrame([(i, f"{PAGE} {i}") for i in range(20)], "page_id bigint, wikitext string")
    e = Engine(spark)
    a, b = (sorted(e.tokens(df.repartition(n)).select(F.xxhash64("page_id", "node_id", "type", "text").alias("h")).collect()) for n in (1, 7))
    assert a == b


def test_stage_planning():
    assert stage_for(["comments"]) == 0 and stage_for(["links", "comments"]) == 5 and stage_for(["nosuch"]) == 10


def test_latency(spark):
    r = ev.latency_stats(spark.createDataFrame([(float(x),) for x in (0, 10)], "v double"), "v").first()
    assert (r.n, r.mean, r.sd, r.p50, r.p95) == (2, 5.0, 5.0, 5.0, 9.5)


def test_builtin_text_functions(spark):
    df = spark.createDataFrame([("a\x00\x7f\r\nb\r", "== x ==\n----\n[[a|b]] <B>t</b> RFC 1 &lt;"), (None, None)], "a string, b string")
    r = df.select(L1.tidy(F.col("a")).alias("t"), L1.headings(F.col("b")).alias("h"), L1.simple_links(F.col("b")).alias("l"), L1.html_tag_names(F.col("b")).alias("n"), L1.identifiers(F.col("b")).alias("i"), L1.rule_count(F.col("b")).alias("r"), titles.normalize(F.col("a")).alias("z")).collect()
    assert r[0].t == "a\nb" and [tuple(x) for x in r[0].h] == [(2, "x")] and [tuple(x) for x in r[0].l] == [("a", "b")] and r[0].n == ["b", "/b"] and r[0].i == ["RFC 1"] and r[0].r == 1
    assert r[1].t is None and r[1].h is None and r[1].z is None


def test_sources(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "A_b.wikitext").write_text("x\ny")
    (tmp_path / "w" / "c.txt").write_text("no")
    assert got(src.wikitext_files(spark, str(tmp_path / "w")), "title", "wikitext") == [("A b", "x\ny")]
    (tmp_path / "w" / "B.wikitext").write_text("z")
    assert [r.title for r in src.wikitext_files(spark, str(tmp_path / "w"), ordered=True).collect()] == ["A b", "B"]
    assert got(src.wikitext_files(spark, str(tmp_path / "w" / "B.wikitext")), "title", "wikitext") == [("B", "z")]
    lines = ['[1, "t", "r", "x"]', '{"id": 2, "title": "u", "timestamp": "s", "wikitext": "y"}', "{bad", '{"title": "z"}', "", '{"id": 3}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    n = src.numbered_lines(spark, str(tmp_path / "p.jsonl"))
    assert [r.line for r in n.orderBy("line").collect()] == [1, 2, 3, 4, 5, 6]
    pages, rejects = src.page_records(n)
    assert got(pages, "line", "page_id", "title", "rev_id", "wikitext") == [(1, 1, "t", "r", "x"), (2, 2, "u", "s", "y")]
    assert got(rejects, "line", "kind") == [(3, "invalid_json"), (4, "invalid_record"), (6, "invalid_record")]
    assert got(src.line_window(n, 2, 3), "line") == [(2,), (3,)]
    have, missing = src.pick_lines(n, [1, 9])
    assert got(have, "line") == [(1,)] and got(missing, "line") == [(9,)]
    src.write_texts(pages, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["page_id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]


def test_packed_and_piped_lines(spark, tmp_path):
    import io

    import zstandard

    (tmp_path / "z").mkdir()
    for name, text in (("a.zst", "x\ny\r\n\nlast"), ("b.zst", "")):
        (tmp_path / "z" / name).write_bytes(zstandard.compress(text.encode()))
    assert got(src.zstd_lines(spark, str(tmp_path / "z")), "line", "value") == [(1, "x"), (2, "y"), (3, ""), (4, "last")]
    assert got(src.piped_lines(spark, io.StringIO("p\nq"), str(tmp_path / "in")), "line", "value") == [(1, "p"), (2, "q")]


def test_tokens_of_one_page_over_several_files(spark, tokens, tmp_path):
    src.write_tokens(tokens, str(tmp_path / "t"), node_bits=4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == tokens.count()


def test_failing_pages(spark):
    from quillspark.kernel.model import BLOCKS
    from quillspark.operators.parse import errors_of

    df = spark.createDataFrame([(1, "[[a]]"), (2, "".join(map(chr, BLOCKS)))], "page_id bigint, wikitext string")
    both = Engine(spark).parsed(df)
    assert got(errors_of(both), "page_id", "kind") == [(2, "ValueError")]
    assert {r.page_id for r in Engine(spark).tokens(df).collect()} == {1} and Engine(spark).parse_errors(df).count() == 1
    assert Engine(spark).tokens(df, columns=("name",)).columns == ["page_id", "name"]


def test_descendants_over_stretches(spark):
    t = Engine(spark).tokens(spark.createDataFrame([(1, "[[a]] " * 700)], "page_id bigint, wikitext string"))
    inside = v.descendants(t, t.filter("subtype in ('root', 'link')"))
    n = t.count()
    assert inside.filter("ancestor = 0").count() == n - 1 and inside.filter("ancestor > 0").count() == 1400


def test_descendant_counts_are_those_of_the_list(spark):
    t = Engine(spark).tokens(spark.createDataFrame([(1, PAGE), (2, "[[a]] {{b|{{c}}}}"), (3, "")], "page_id bigint, wikitext string")).cache()
    listed = v.descendants(t, t).groupBy("page_id", "ancestor").count()
    counts = v.descendant_counts(t)
    assert counts.count() == t.count()
    assert got(counts.filter("inside > 0"), "page_id", "ancestor", "inside") == got(listed, "page_id", "ancestor", "count")


def test_descendants_of_each_row_of_orders(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 0), (2, 43), (3, 79)], "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    assert got(wiki.descendants(spark, str(tmp_path)), "page_id", "inside") == [(1, 6), (1, 6), (2, 24), (3, 240)]


def test_nested_templates_of_each_pair_of_keys(spark, tmp_path):
    rows = [(1, 12), (2, 2), (1, 12), (1, 1), (1, 1), (3, 7)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert got(wiki.template_nested(spark, str(tmp_path)), "page_id", "uses") == [(11, 1), (22, 2), (37, 1)]


def test_text_that_comes_again_is_parsed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def emit(title, text):
        made.add(1)
        return [(title, w) for w in (text or "").split()]

    rows = [(i, ("P", "Q")[i % 2], ("a b c", "", None, "d")[i % 4]) for i in range(400)]
    out = map_pages(spark.createDataFrame(rows, "page_id bigint, title string, wikitext string").coalesce(1), "t string, w string", emit)
    assert got(out, "page_id", "t", "w") == sorted(((i, t, w) for i, t, text in rows for w in (text or "").split()), key=str)
    assert made.value == 4
    # Pages of more rows than a batch holds, and of very many of a few rows.
    huge = spark.createDataFrame([(1, "[[a]]" * 12_000), (2, "[[a]]" * 12_000), *((3 + i, "[[a]]") for i in range(15_000))], "page_id bigint, wikitext string").coalesce(1)
    n = Engine(spark).tokens(huge, columns=("node_id", "subtype")).groupBy(F.least("page_id", F.lit(3)).alias("page")).agg(F.count("*").alias("rows"), F.count_distinct("page_id", "node_id").alias("nodes"))
    assert got(n, "page", "rows", "nodes") == [(1, 36_001, 36_001), (2, 36_001, 36_001), (3, 60_000, 60_000)]


def test_only_rows_with_given_values(spark):
    from quillspark.kernel.model import BLOCKS
    from quillspark.operators.parse import errors_of

    df = spark.createDataFrame([(1, "{{a|{{c}}}} {{c}} [[c]]"), (2, "".join(map(chr, BLOCKS)))], "page_id bigint, wikitext string")
    t = Engine(spark).tokens(df, columns=("depth", "name"), where={"subtype": "template", "in_template": True})
    assert t.columns == ["page_id", "depth", "name"] and got(t, *t.columns) == [(1, 4, "Template:C")]
    assert got(Engine(spark).tokens(df, columns=("depth",), where={"value": "c"}), "page_id", "depth") == got(Engine(spark).tokens(df).filter("value = 'c'"), "page_id", "depth")
    assert got(errors_of(Engine(spark).parsed(df, where={"subtype": "link"})), "page_id", "kind") == [(2, "ValueError")]


def test_failure_records(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "page_id bigint, text string")
    bad = spark.createDataFrame([(2, 1, "interval")], "page_id bigint, node_id int, problem string")
    rows = ev.failure_records(df((1, "a"), (2, "b"), (3, "c")), df((1, "a"), (2, "b"), (3, "cc")), df((1, "a"), (2, "b"), (3, "c")), bad)
    assert [tuple(r) for r in rows.orderBy("page_id").collect()] == [(2, True, False, True, 1, 1, ["interval"]), (3, True, True, False, 1, 2, [])]


def test_stream(spark, tmp_path):
    rows = "SELECT 1L page_id, 't' title, 'r' rev_id, '[[A]]' wikitext, timestamp'2025-01-01' rev_ts, timestamp'2025-01-02' loaded_at"
    spark.sql(f"{rows} UNION ALL {rows}").coalesce(1).write.parquet(str(tmp_path / "in"))
    new = stream.new_revisions(stream.page_stream(spark, str(tmp_path / "in")))
    q = stream.token_stream(new).writeStream.format("memory").queryName("toks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM toks WHERE subtype = 'link'").first()[0] == 1
    w = stream.revisions_per_window(stream.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.sql("SELECT revisions, pages FROM wins").first() == (2, 1)


def test_table_function(spark):
    Engine(spark).register_sql()
    assert spark.sql("SELECT t.name FROM (SELECT '[[a]]' x) p, LATERAL wikitext_tokens(p.x) t WHERE t.subtype = 'link'").first()[0] == "A"


def test_parity_and_schema_read_every_revision(spark, tmp_path, monkeypatch):
    rows = [(1, "P", "a old"), (1, "P", "z new"), (1, "P", "z new"), (2, "Q", "b")]
    spark.createDataFrame(rows, "page_id bigint, title string, wikitext string").write.parquet(str(tmp_path / "pages_raw.parquet"))
    assert got(wiki.page_parity(spark, str(tmp_path)), "page_id", "text_equal") == [(1, True), (2, True)]
    assert wiki.schema_violations(spark, str(tmp_path)).count() == 0
    whole = Engine.to_text
    monkeypatch.setattr(Engine, "to_text", lambda *a: whole(*a).withColumn("text", F.replace("text", F.lit("old"), F.lit(""))))
    assert got(wiki.page_parity(spark, str(tmp_path)), "page_id", "text_equal") == [(1, False), (2, True)]
    monkeypatch.setattr(wiki.ev, "schema_violations", lambda t: t.filter("subtype = 'root'"))
    assert [r.page_id for r in wiki.schema_violations(spark, str(tmp_path)).orderBy("page_id").collect()] == [1, 1, 1, 2]
