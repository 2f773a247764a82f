"""Facts from the token table: links, templates, sections, tables and the rest.

A view groups a node with the roles among its children by (page_id, node) in one shuffle;
that key is spread even where one page holds a third of all rows. Views that need order only
use windows over the few rows of their own role.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["page_id", "node_id"]


def with_roles(tokens: DataFrame, main: Sequence[str], roles: dict[str, str], keep: Sequence[str | Column] = ("name",)) -> DataFrame:
    """(page_id, node_id, keep..., roles...): nodes of the ``main`` subtypes with the values of their children by role."""
    is_main = F.col("subtype").isin(*main)
    rows = tokens.filter(is_main | F.col("subtype").isin(*roles.values()))
    key = F.when(is_main, F.col("node_id")).otherwise(F.col("parent_id"))
    kept = F.struct(*[F.col(k) if isinstance(k, str) else k for k in keep])
    # A role's node may itself be of a main subtype only in odd trees; the key then is its own.
    out = rows.groupBy("page_id", key.alias("node_id")).agg(
        F.max(F.when(is_main, kept)).alias("_k"), *[F.max(F.when(F.col("subtype") == s, F.struct("node_id", "value")))["value"].alias(r) for r, s in roles.items()]
    )
    return out.filter(F.col("_k").isNotNull()).select("page_id", "node_id", "_k.*", *roles)


def _p(field: str) -> Column:
    return F.col("payload")[field].alias(field)


def redirects(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "redirect").select(*KEY, F.col("payload.link").alias("target"), F.col("payload.display").alias("display"), F.col("name").alias("title"))


def links(t: DataFrame) -> DataFrame:
    out = with_roles(t, ["link"], {"target_raw": "link-target", "text": "link-text"}, ["name", _p("ns"), _p("interwiki"), _p("fragment"), _p("forced"), "in_template", "in_ref"])
    return out.withColumnRenamed("name", "title")


def categories(t: DataFrame) -> DataFrame:
    return with_roles(t, ["category"], {"target_raw": "link-target", "sort_key": "link-text"}).withColumnRenamed("name", "title")


def files(t: DataFrame) -> DataFrame:
    kinds = {"file": "file", "gallery-image": "gallery", "imagemap-image": "imagemap"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("subtype")].alias("kind")
    main = with_roles(t, list(kinds), {"target_raw": "link-target"}, ["name", kind]).withColumnRenamed("name", "title")
    params = file_params(t).groupBy("page_id", F.col("file_node").alias("node_id")).agg(
        F.max(F.when(F.col("param_name") == "caption", F.struct("ordinal", "value")))["value"].alias("caption"), F.max(F.when(F.col("param_name") == "width", F.col("value"))).alias("_w")
    )
    w = F.regexp_replace("_w", "px$", "")
    return main.join(params, KEY, "left").select(*KEY, "title", "kind", "target_raw", "caption", F.nullif(F.split_part(w, F.lit("x"), F.lit(1)), F.lit("")).alias("width"), F.nullif(F.split_part(w, F.lit("x"), F.lit(2)), F.lit("")).alias("height"))


def file_params(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "image-parameter").select(*KEY, F.col("parent_id").alias("file_node"), F.col("child_ix").alias("ordinal"), F.col("name").alias("param_name"), "value")


def template_uses(t: DataFrame) -> DataFrame:
    out = with_roles(t, ["template"], {"raw_name": "template-name"}, ["name", _p("modifier"), "depth", "in_template"])
    return out


def template_params(t: DataFrame) -> DataFrame:
    """Parameters of templates and magic words, with their 1-based place."""
    out = with_roles(t, ["parameter"], {"key": "parameter-key", "value": "parameter-value"}, ["name", _p("anon"), F.col("parent_id").alias("call_node"), F.col("child_ix").alias("ordinal")])
    calls = t.filter(F.col("subtype").isin("template", "magic-word")).select("page_id", F.col("node_id").alias("call_node"), F.col("name").alias("call"), F.col("subtype").alias("call_kind"))
    return out.withColumnRenamed("name", "param_name").join(calls, ["page_id", "call_node"])


def template_summary(t: DataFrame) -> DataFrame:
    """Per call: parameters, anonymous ones, and whether a name comes twice."""
    return template_params(t).groupBy("page_id", "call_node", "call").agg(
        F.count("*").alias("params"), F.count_if("anon").alias("anon_count"), (F.count("param_name") > F.count_distinct("param_name")).alias("duplication")
    )


def template_args(t: DataFrame) -> DataFrame:
    return with_roles(t, ["arg"], {"raw_name": "arg-name", "default": "arg-default", "extra": "hidden"})


def magic_words(t: DataFrame) -> DataFrame:
    return with_roles(t, ["magic-word"], {"raw_name": "magic-word-name"}, ["name", _p("modifier")])


def invocations(t: DataFrame) -> DataFrame:
    return t.filter((F.col("subtype") == "magic-word") & F.col("payload.module").isNotNull()).select(*KEY, F.col("payload.module").alias("module"), F.col("payload.function").alias("function"))


def sections(t: DataFrame) -> DataFrame:
    """Headings in order, each with its parent section and the last node that belongs to it; their order comes with the tokens."""
    h = with_roles(t, ["heading"], {"title": "heading-title"}, [_p("level"), _p("ordinal"), _p("parent_section"), _p("end_node")])
    return h.select(*KEY, "level", F.trim("title").alias("title"), "ordinal", "parent_section", "end_node")


def ext_links(t: DataFrame) -> DataFrame:
    """Bracketed and bare external links."""
    bracketed = with_roles(t, ["ext-link"], {"url": "ext-link-url", "text": "ext-link-text"}, [F.lit(True).alias("bracketed")])
    bare = t.filter(F.col("subtype") == "free-ext-link").select(*KEY, F.lit(False).alias("bracketed"), F.col("value").alias("url"), F.lit(None).cast("string").alias("text"))
    both = bracketed.unionByName(bare)
    return both.select(*KEY, "bracketed", "url", F.nullif(F.lower(F.regexp_extract("url", "^([A-Za-z][\\w+.-]*:(?://)?|//)", 1)), F.lit("")).alias("protocol"), "text")


def identifiers(t: DataFrame) -> DataFrame:
    value = F.regexp_replace(F.regexp_replace("value", "^[A-Za-z]+\\s+", ""), "[\\s-]", "")
    return t.filter(F.col("subtype") == "magic-link").select(*KEY, F.col("name").alias("kind"), value.alias("value"))


def ext_tags(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "ext").select(*KEY, F.col("name").alias("tag"), _p("self_closing"), F.col("payload.ext_attr").alias("attrs"), F.col("payload.ext_inner").alias("inner_text"))


def _attrs(t: DataFrame, kind: str) -> DataFrame:
    rows = with_roles(t, [f"{kind}-attr"], {"key": "attr-key", "value": "attr-value"}, ["name", _p("equal"), _p("quote_open"), F.col("parent_id").alias("attrs_node")])
    holder = {"ext": "ext-attrs", "html": "html-attrs", "table": "table-attrs"}[kind]
    owners = t.filter(F.col("subtype") == holder).select("page_id", F.col("node_id").alias("attrs_node"), F.col("parent_id").alias("owner_node"), F.col("name").alias("tag"))
    return rows.join(owners, ["page_id", "attrs_node"]).select(*KEY, "owner_node", "tag", F.col("name").alias("attr"), F.when(F.col("equal").isNotNull(), F.coalesce("value", F.lit(""))).alias("value"), F.col("quote_open").alias("quote"))


def ext_attrs(t: DataFrame) -> DataFrame:
    return _attrs(t, "ext")


def html_attrs(t: DataFrame) -> DataFrame:
    return _attrs(t, "html")


def table_attrs(t: DataFrame) -> DataFrame:
    return _attrs(t, "table")


def attr_errors(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype").endswith("attr-dirty") & (F.trim(F.regexp_replace("value", "\\s", "")) != "")).select(*KEY, "subtype", "value")


def refs(t: DataFrame) -> DataFrame:
    """Footnotes with their name; a named one is numbered by its first use on the page."""
    return t.filter((F.col("subtype") == "ext") & (F.col("name") == "ref")).select(*KEY, _p("ref_name"), F.col("payload.ext_inner").alias("inner_text"), _p("self_closing"), _p("number"))


def html_tags(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "html").select(*KEY, F.col("name").alias("tag"), _p("closing"), _p("self_closing"), _p("orig_tag"))


def tables(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "table").select(*KEY, "depth", "subtree_end")


def table_rows(t: DataFrame) -> DataFrame:
    rows = t.filter(F.col("subtype") == "tr").select(*KEY, F.col("parent_id").alias("table_node"), "child_ix")
    return rows.select(*KEY, "table_node", F.row_number().over(Window.partitionBy("page_id", "table_node").orderBy("child_ix")).alias("row_ix"))


def table_cells(t: DataFrame) -> DataFrame:
    """Cells with row and column, 1-based; cells before the first row mark have row 0 unless they are the caption."""
    cells = with_roles(t, ["td"], {"text": "td-inner"}, [F.col("name").alias("kind"), F.col("parent_id").alias("_p"), F.col("child_ix").alias("_i")])
    rows = table_rows(t).select("page_id", F.col("node_id").alias("_p"), "table_node", "row_ix")
    spans = table_attrs(t).filter(F.col("attr").isin("colspan", "rowspan")).groupBy("page_id", F.col("owner_node").alias("node_id")).agg(
        F.max(F.when(F.col("attr") == "colspan", F.expr("try_cast(value AS int)"))).alias("colspan"), F.max(F.when(F.col("attr") == "rowspan", F.expr("try_cast(value AS int)"))).alias("rowspan")
    )
    out = cells.join(rows, ["page_id", "_p"], "left").join(spans, KEY, "left")
    col = F.row_number().over(Window.partitionBy("page_id", "_p").orderBy("_i"))
    return out.select(*KEY, F.coalesce("table_node", "_p").alias("table_node"), F.coalesce("row_ix", F.lit(0)).alias("row_ix"), col.alias("col_ix"), "kind", F.trim("text").alias("text"), F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("rowspan", F.lit(1)).alias("rowspan"))


def list_marks(t: DataFrame) -> DataFrame:
    v = F.col("value")
    return t.filter(F.col("subtype").isin("list", "dd")).select(
        *KEY, "subtype", v.alias("markers"), F.length(v).alias("depth"), (F.length(v) - F.length(F.translate(v, ":", ""))).alias("indent"), v.contains("*").alias("ul"), v.contains("#").alias("ol"), v.contains(";").alias("dt")
    )


def page_flags(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "double-underscore").select(*KEY, F.col("name").alias("flag"), F.col("value").alias("written"), _p("case_sensitive"))


def comments(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "comment").select(*KEY, F.col("value").alias("text"), _p("closed"))


def variants(t: DataFrame) -> DataFrame:
    return with_roles(t, ["converter-rule"], {"from": "converter-rule-from", "lang": "converter-rule-variant", "to": "converter-rule-to"}, [F.col("parent_id").alias("converter_node")])


def variant_flags(t: DataFrame) -> DataFrame:
    """Flags of each converter, in order of the text."""
    flags = t.filter((F.col("subtype") == "converter-flag") & (F.trim("value") != "")).select("page_id", F.col("parent_id").alias("flags_node"), F.struct("child_ix", F.trim("value").alias("flag")).alias("f"))
    return flags.groupBy("page_id", "flags_node").agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["flag"]).alias("flags"))


def image_areas(t: DataFrame) -> DataFrame:
    shape = F.lower(F.regexp_extract("value", "^\\s*(\\w+)", 1))
    return t.filter(F.col("subtype") == "imagemap-link").select(*KEY, shape.alias("shape"), F.regexp_extract("value", "(\\[.*\\])", 1).alias("link"))


def style_marks(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "quote").select(*KEY, _p("bold"), _p("italic"))


def rules(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype") == "hr").select(*KEY, F.length("value").alias("dashes"))


def ext_params(t: DataFrame) -> DataFrame:
    """key=value lines of parameter-like extension tags."""
    v = F.col("value")
    return t.filter((F.col("subtype") == "param-line") & v.contains("=")).select(*KEY, F.lower(F.trim(F.split_part(v, F.lit("="), F.lit(1)))).alias("key"), F.trim(F.regexp_replace(v, "(?s)^[^=]*=", "")).alias("value"))


def includes(t: DataFrame) -> DataFrame:
    return t.filter(F.col("subtype").isin("noinclude", "include", "onlyinclude")).select(*KEY, "subtype", "value")


def edges(t: DataFrame) -> DataFrame:
    """(page_id, rel, dst): the knowledge graph of the pages, in one pass over the tokens without a shuffle."""
    role, name, value = F.col("subtype"), F.col("name"), F.col("value")
    named = {"link": "linksTo", "category": "hasCategory", "template": "usesTemplate", "redirect": "redirectsTo", **dict.fromkeys(("file", "gallery-image", "imagemap-image"), "usesFile")}
    module = F.col("payload.module")
    rel, dst = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, r in named.items():
        rel, dst = F.when(role == k, F.lit(r)).otherwise(rel), F.when(role == k, name).otherwise(dst)
    url = role.isin("ext-link-url", "free-ext-link")
    rel, dst = F.when(url, F.lit("externalLink")).when((role == "magic-word") & module.isNotNull(), F.lit("invokes")).otherwise(rel), F.when(url, value).when(role == "magic-word", module).otherwise(dst)
    return t.filter(role.isin(*named, "ext-link-url", "free-ext-link", "magic-word")).select("page_id", rel.alias("rel"), dst.alias("dst")).filter(F.col("rel").isNotNull())


#: Nodes of a page are met by their ancestors in stretches of this many bits of the node number.
STRETCH_BITS = 10


def descendants(t: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(page_id, ancestor, node_id) by the interval of each ancestor: an equi-join on the page and a stretch of its
    nodes, so that one huge page is spread over tasks and an ancestor meets only the stretches it reaches into."""
    stretch = lambda c: F.shiftright(F.col(c), STRETCH_BITS)
    a = ancestors.filter(F.col("subtree_end") > F.col("node_id")).select("page_id", F.col("node_id").alias("ancestor"), F.col("subtree_end").alias("_e"), F.explode(F.sequence(stretch("node_id"), stretch("subtree_end"))).alias("_s"))
    nodes = t.select("page_id", "node_id", stretch("node_id").alias("_s"))
    return nodes.join(a, ["page_id", "_s"]).filter((F.col("node_id") > F.col("ancestor")) & (F.col("node_id") <= F.col("_e"))).select("page_id", "ancestor", "node_id")


def descendant_counts(ancestors: DataFrame) -> DataFrame:
    """(page_id, ancestor, inside): how many nodes ``descendants`` lists for each row; the interval tells it, so no other row is needed and nothing is joined."""
    return ancestors.select("page_id", F.col("node_id").alias("ancestor"), (F.col("subtree_end") - F.col("node_id")).cast("bigint").alias("inside"))


ALL = (redirects, links, categories, files, file_params, template_uses, template_params, template_summary, template_args, magic_words, invocations, sections, ext_links, identifiers, ext_tags, refs, ext_attrs, html_tags, html_attrs, tables, table_rows, table_cells, table_attrs, attr_errors, list_marks, page_flags, comments, variants, variant_flags, image_areas, style_marks, rules, ext_params, includes, edges)
