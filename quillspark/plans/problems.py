"""Queries of the general problems on copies and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import copy_diff, nested
from quillspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_diff.token_copy_diff(table(spark, d, "tokens"), table(spark, d, "tokens_other"))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("field").agg(F.count("*").alias("nodes"))


def _nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nested.flatten_trees(table(spark, d, "trees"), columns or nested.COLUMNS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, *nested.KEY)


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d)


def p5_names(spark: SparkSession, d: str) -> DataFrame:
    return nested.names_table(_nodes(spark, d, "page_id", "node_id", "name"))


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "variant", "typed_table", "shape").groupBy("variant", "typed_table", "shape").agg(F.count("*").alias("nodes"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of tables how many nodes of the one are children of nodes of the other; every link has its parent."""
    nodes = _nodes(spark, d, "page_id", "node_id", "parent_id", "typed_table")
    up = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("typed_table").alias("parent_table"))
    rows = nodes.filter("parent_id >= 0").join(up, ["page_id", "parent_id"], "left")
    return rows.groupBy("parent_table", "typed_table").agg(F.count("*").alias("nodes"))


def _typed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def typed(spark: SparkSession, d: str) -> DataFrame:
        return nested.typed_tables(_nodes(spark, d, *nested.KEY, "variant", "typed_table", *nested.TABLE_COLUMNS[name]))[name]

    return typed


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p1_found, p1_summary, p5_found, p5_nodes, p5_names, p5_variants, p5_links)}
    return own | {f"p5_table_{name}": _typed(name) for name in nested.TABLES}


def oracle_sql() -> dict[str, str]:
    side = """SELECT page_id, node_id, arg_max(struct_pack(
            n := nullif(name, ''), ty := nullif(type, ''), s := nullif(subtype, ''), lv := payload.level,
            c := CASE WHEN len(children) > 0 THEN list_transform(children, lambda x: CASE WHEN x IS NULL THEN NULL ELSE struct_pack(a := CASE WHEN x.is_text THEN 1 ELSE 0 END, b := coalesce(x.text, ''), d := coalesce(x.node_id, -1)) END) END
        ), loaded_at) AS v FROM {} GROUP BY ALL"""
    found = f"""WITH l AS ({side.format("tokens")}), r AS ({side.format("tokens_other")}),
        j AS (SELECT coalesce(l.page_id, r.page_id) AS page_id, coalesce(l.node_id, r.node_id) AS node_id, l.v AS a, r.v AS b, l.page_id IS NULL AS ml, r.page_id IS NULL AS mr
              FROM l FULL JOIN r ON l.page_id = r.page_id AND l.node_id = r.node_id)
        SELECT page_id, node_id, 'missing_left' AS field FROM j WHERE ml UNION ALL SELECT page_id, node_id, 'missing_right' FROM j WHERE mr
        UNION ALL SELECT page_id, node_id, 'name' FROM j WHERE NOT ml AND NOT mr AND a.n IS DISTINCT FROM b.n
        UNION ALL SELECT page_id, node_id, 'children' FROM j WHERE NOT ml AND NOT mr AND a.c IS DISTINCT FROM b.c
        UNION ALL SELECT page_id, node_id, 'type' FROM j WHERE NOT ml AND NOT mr AND a.ty IS DISTINCT FROM b.ty
        UNION ALL SELECT page_id, node_id, 'subtype' FROM j WHERE NOT ml AND NOT mr AND a.s IS DISTINCT FROM b.s
        UNION ALL SELECT page_id, node_id, 'level' FROM j WHERE NOT ml AND NOT mr AND a.lv IS DISTINCT FROM b.lv"""
    # The nodes of a tree by recursion over its JSON; paths in order give the document order.
    kids = "list_filter(CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN []::JSON[] ELSE [{0}] END, lambda x: json_type(x) <> 'NULL')"
    held = "CASE WHEN json_type(v->'children') IS NOT NULL AND json_type(v->'children') <> 'NULL' THEN v->'children' ELSE v->'childNodes' END"
    token = """CASE WHEN json_type(c) <> 'OBJECT' THEN NULL
            WHEN json_type(c->'type') = 'VARCHAR' THEN CASE WHEN c->>'type' = 'text' AND NOT json_exists(c, '$.children') AND NOT json_exists(c, '$.childNodes') THEN NULL ELSE c END
            WHEN json_type(c->'token') = 'OBJECT' AND coalesce(c->>'is_text', 'false') = 'false' THEN c->'token' END"""
    nodes = f"""WITH RECURSIVE w AS (SELECT page_id, loaded_at, CASE WHEN json_type(j->'type') IS NULL AND json_type(j->'token') = 'OBJECT' THEN j->'token' ELSE j END AS v
            FROM (SELECT page_id, loaded_at, ast::JSON AS j FROM trees WHERE json_valid(ast)) WHERE json_type(j) = 'OBJECT'),
        good AS (SELECT page_id, arg_max(v, coalesce(loaded_at, '-infinity'::TIMESTAMP)) AS v FROM w WHERE json_type(v->'type') = 'VARCHAR' GROUP BY page_id),
        n AS (SELECT page_id, []::INTEGER[] AS path, v, v AS c FROM good
            UNION ALL SELECT page_id, list_append(path, ix), {token}, c FROM (
                SELECT page_id, path, unnest(k) AS c, (generate_subscripts(k, 1) - 1)::INTEGER AS ix FROM (
                    SELECT page_id, path, {kids.format("h")} AS k FROM (SELECT page_id, path, {held} AS h FROM n WHERE v IS NOT NULL) WHERE h IS NOT NULL))),
        m AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY path) - 1)::INTEGER AS node_id FROM n)"""
    links = f"""{nodes} SELECT a.page_id, a.node_id, coalesce(b.node_id, -1) AS parent_id, CASE WHEN len(a.path) = 0 THEN 0 ELSE a.path[-1] END AS child_ix
        FROM m a LEFT JOIN m b ON len(a.path) > 0 AND b.page_id IS NOT DISTINCT FROM a.page_id AND b.path = a.path[:-2]"""
    text = "coalesce(CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' ELSE CASE WHEN json_type(c->'text') = 'VARCHAR' THEN c->>'text' END END, '')"
    is_text = "v IS NULL AND (json_type(c) = 'VARCHAR' OR (json_type(c) = 'OBJECT' AND (c->>'type' = 'text' OR coalesce(c->>'is_text', 'false') <> 'false' OR json_type(c->'text') = 'VARCHAR' OR c::VARCHAR = '{}')))"
    given = lambda *keys: " OR ".join(f"coalesce(json_type(v->'{k}'), 'NULL') <> 'NULL'" for k in keys)
    of_class = f"""CASE WHEN {is_text} THEN 'text' WHEN v IS NULL THEN 'opaque' WHEN {given('orig_tag')} THEN 'markup_tag' WHEN {given('bold', 'italic')} THEN 'style' WHEN {given('level')} THEN 'heading'
        WHEN {given('closed', 'closing', 'self_closing')} THEN 'closable' WHEN coalesce(v->>'name', '') <> '' THEN 'named' ELSE 'plain' END"""
    # A node's table depends on what its children are.
    tables = f"""{nodes}, k AS (SELECT page_id, path, node_id, {of_class} AS cls FROM m), h AS (SELECT page_id, path[:-2] AS up, max(CASE WHEN cls <> 'text' THEN 1 ELSE 0 END) AS holds FROM k WHERE len(path) > 0 GROUP BY ALL),
        t AS (SELECT k.page_id, k.path, CASE cls WHEN 'named' THEN CASE WHEN holds = 1 THEN 'container' ELSE 'labelled' END WHEN 'plain' THEN CASE WHEN holds = 1 THEN 'group' ELSE 'leaf' END ELSE cls END AS typed
            FROM k LEFT JOIN h ON k.page_id IS NOT DISTINCT FROM h.page_id AND k.path = h.up)"""
    typed = {
        "p5_links": f"{tables} SELECT b.typed AS parent_table, a.typed AS typed_table, count(*) AS nodes FROM t a LEFT JOIN t b ON b.page_id IS NOT DISTINCT FROM a.page_id AND b.path = a.path[:-2] WHERE len(a.path) > 0 GROUP BY ALL",
        "p5_found": links,
        "p5_names": f"{nodes} SELECT page_id, node_id, v->>'name' AS name FROM m WHERE json_type(v->'name') = 'VARCHAR' AND v->>'name' <> ''",
        "p5_table_text": f"SELECT page_id, node_id, parent_id, child_ix, variant, text FROM ({links}) JOIN ({nodes} SELECT page_id, node_id, CASE json_type(c) WHEN 'VARCHAR' THEN 'text' ELSE 'wrapped_text' END AS variant, {text} AS text FROM m WHERE {is_text}) USING (page_id, node_id)",
    }
    return typed | {"p1_found": found, "p1_summary": f"SELECT field, count(*) AS nodes FROM ({found}) GROUP BY field"}
