"""The text operators on small tables: nulls, ties, repeats, empty tables, clashing columns."""

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.llm import abuse, frames, mix, pack, tokens
from quillspark.llm.queries import _sized, oracle_sql, queries
from quillspark.llm.tokens import TOKENIZER, counter, with_token_counts

T = datetime(2025, 1, 1)
DOC = "doc_id bigint, title string, text string, lang string, source string"
TOK = "page_id bigint, node_id int, name string, loaded_at timestamp"
SEC = "page_id bigint, section_ix int, level int, text string, loaded_at timestamp"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Talk:A", "plain words here and there", "en", "a-b"), (2, None, None, None, None), (3, "B", "", "", " A_B "), (4, "C", "  \n ", "de-x", "c"), (5, "D", "'''bold''' <b>x</b>", "fr", "c"), (5, "D", "'''bold''' <b>x</b>", "fr", "c"),
        (6, "E", "- a\n- b\n- c", "en", "c"), (7, "F", "word " * 3000, "en", "c"), (None, "G", "no id at all", "en", "d"), (8, "H", "You are a useless moron and everyone knows it.", "en", "d"),
    ]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 as tokens", "2 as rec_id", "3 as _s", "4 as kind").cache()


@pytest.fixture(scope="module")
def names(spark):
    later = datetime(2025, 2, 1)
    rows = [(1, 1, "''x''", T), (1, 1, None, later), (1, 2, "old", T), (1, 2, "<b>new</b>", later), (1, 2, "<b>new</b>", later), (2, 1, "vS64p4XaXFdIV", T), (2, 2, "", T), (2, 3, "abc", None)]
    return spark.createDataFrame(rows, TOK)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_markup(spark, docs, names):
    want = [("documents", 5, -1, "html"), ("documents", 5, -1, "wiki"), ("tokens", 1, 2, "html")]
    assert got(frames.markup_kinds(docs, names)) == want
    assert frames.markup_kinds(docs.limit(0), names.limit(0)).count() == 0
    assert frames.clean_documents(docs).count() == docs.count()
    assert got(frames.clean_names(names)) == [(1, 2, "<b>new</b>", "new")]


def test_forms(docs, names):
    assert got(frames.forms(docs, names)) == [("documents", 6, -1, "list"), ("documents", 7, -1, "junk"), ("tokens", 2, 1, "junk")]
    assert frames.document_statistics(docs).count() == docs.count() and frames.name_statistics(names).count() == 3


def test_sections(spark):
    big = "a" * 1500 + "\n\n" + "b" * 1500
    rows = [(1, 0, None, big, T), (1, 0, None, big, T), (1, 1, 2, "x" * 2001, T), (1, 2, 2, None, T), (2, 0, None, big, T), (2, 0, None, "short now", datetime(2025, 3, 1)), (3, 0, 1, "y" * 2000 + "  \n", T), (4, 0, 1, "z", T)]
    s = spark.createDataFrame(rows, SEC)
    assert got(frames.oversized_sections(s)) == [(1, 0, "paragraph"), (1, 1, "none")]
    p = frames.section_pieces(s, 2000, 200)
    assert p.filter("length(text) > 2000").count() == 0 and [r[0] for r in p.filter("page_id = 1 and section_ix = 0").orderBy("piece_ix").select("cut").collect()] == ["paragraph", "paragraph"]
    assert frames.oversized_sections(s.limit(0)).count() == 0 and frames.section_pieces(s.limit(0), 2000, 200).count() == 0


def test_both_section_queries_read_the_same_row(spark):
    """Rows of one key and one time that differ: the pieces are those of the text whose cut is named."""
    rows = [(p, 0, lv, t, T) for p in range(30) for lv, t in ((1, "a" * 1500 + "\n\n" + "b" * (900 + p)), (2, "short"), (None, "x" * 2400))]
    s = spark.createDataFrame(rows, SEC).repartition(3)
    named = {r.page_id: r.cut for r in frames.oversized_sections(s).collect()}
    pieces = {}
    for r in frames.section_pieces(s, 2000, 100).orderBy("page_id", "piece_ix").collect():
        pieces.setdefault(r.page_id, []).append(r.cut)
    want = {p: None if len(c) == 1 else "paragraph" if c[0] == "paragraph" else "none" for p, c in pieces.items()}
    assert {p: c for p, c in want.items() if c} == named and len(pieces) == 30


def test_packing(docs):
    packed = pack.pack_documents(docs, [(1, 64), (2, 7)], _sized).cache()
    for i, cap in ((1, 64), (2, 7)):
        p = packed.filter(F.col("limit_id") == i)
        assert p.groupBy("container_id").agg(F.sum("tokens").alias("t")).filter(f"container_id is not null and t > {cap}").count() == 0
        assert p.filter("tokens = 0").select("container_id").distinct().collect()[0][0] is None
        n = with_token_counts(docs, {"doc_id": "bigint"})
        assert p.agg(F.sum("tokens")).first()[0] == n.agg(F.sum("tokens")).first()[0]
        # Only documents above the capacity are divided.
        whole = n.filter(f"tokens <= {cap}").count()
        assert p.filter("piece_ix = 0").count() == docs.count() and p.filter(f"tokens <= {cap} and piece_ix = 0").count() >= whole
    assert pack.report(packed).count() == 2
    assert pack.pack_documents(docs.limit(0), [(1, 64)], _sized).count() == 0


def test_packing_skewed_lengths(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 17).alias("n"))
    old, pack.RANK_ROWS = pack.RANK_ROWS, 100
    try:
        p = pack.assign(df, ["doc_id"], "n", 20).cache()
    finally:
        pack.RANK_ROWS = old
    assert p.count() == 5000 and p.groupBy("container_id").agg(F.sum("tokens").alias("t")).filter("container_id is not null and t > 20").count() == 0
    boxes = p.select("container_id").distinct().count() - 1
    assert p.agg(F.sum("tokens")).first()[0] / (boxes * 20) > 0.97


def test_mixing(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.repeat(F.lit("word "), (F.col("id") % 30).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "B_b").otherwise("c").alias("source"))
    m = spark.createDataFrame([("m", "a", 1.0, 1, 0.5), ("m", "b-b", 2.0, None, 0.5), ("m", "gone", 5.0, 1, 0.5), ("m", "c", None, 1, 0.5), ("n", "a", 1.0, 1, 2.0), ("n", "c", 1.0, 3, 2.0)], "mix_name string, source string, weight double, max_repeats int, size_factor double")
    keep = {"doc_id": "bigint", "source": "string", "lang": "string", "topic": "string"}
    drawn, sized = mix.draw(d, m, lambda x: with_token_counts(x, keep))
    s = {(r.mix_name, r.source): r for r in mix.shares(drawn, sized, m).collect()}
    assert abs(s["m", "a"].actual_share - 1 / 3) < 0.01 and abs(s["m", "b-b"].actual_share - 2 / 3) < 0.01 and s["m", "gone"].drawn_tokens == 0 and s["m", "c"].drawn_tokens == 0
    assert s["n", "a"].most_repeats == 1 and s["n", "c"].most_repeats <= 3 and s["n", "a"].drawn_tokens == s["n", "a"].tokens_at_hand
    assert mix.draw(d.limit(0), m, lambda x: with_token_counts(x, keep))[0].count() == 0


def test_abuse_frames(spark, docs):
    labels = spark.createDataFrame([(1, "r", " OK "), (8, "r", "abusive"), (8, "s", "ok"), (5, "r", None), (99, "r", "hateful"), (None, "r", "ok")], "doc_id bigint, reviewer string, label string")
    s = frames.abuse_scores(docs, labels)
    assert s.count() == docs.count() and [r.doc_id for r in s.filter(F.col("abusive") >= abuse.THRESHOLD).collect()] == [8]


def test_token_counts(monkeypatch):
    count = counter(TOKENIZER)
    assert count(None) == count("") == 0 and count("hello world") == 2
    began = time.process_time()
    assert count("ab" * 500_000) > 0 and count(" " * 1_000_000) > 0 and count("\n" * 1_000_000 + "x") > 0 and time.process_time() - began < 20
    texts = ["a" + " " * 30 + "b", "\n" * 40, " " * 20 + "x " + "\t" * 25, "no run"]
    want = [count(t) for t in texts]
    monkeypatch.setattr(tokens, "_BLANKS", re.compile(r"\s{10,}"))
    monkeypatch.setattr(tokens, "LONG_BLANKS", 1)
    assert [count(t) for t in texts] == want


def test_every_query_is_registered_once():
    q = queries()
    assert set(oracle_sql()) <= set(q) and {f"p{n}_found" for n in (2, 3, 4, 8)} <= set(q)


def test_one_step_of_a_source_is_put_in_order(spark, monkeypatch):
    """A source drawn at one in a hundred: the window sees about one step of it, the draws meet the budget."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.lit("some words of a text").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source")).repartition(8)
    m = spark.createDataFrame([("m", "a", 1.0, 1, 0.01)], "mix_name string, source string, weight double, max_repeats int, size_factor double")
    keep = {"doc_id": "bigint", "source": "string", "lang": "string", "topic": "string"}
    monkeypatch.setattr(mix, "STEP_ROWS", 200)
    seen = []
    whole = mix.by_chance

    def watched(each, steps):
        out = whole(each, steps)
        seen.append((out.filter("_g = _edge").count(), out.count()))
        return out

    monkeypatch.setattr(mix, "by_chance", watched)
    drawn, sized = mix.draw(d, m, lambda x: with_token_counts(x, keep))
    total, got_ = sized.agg(F.sum("tokens")).first()[0], drawn.agg(F.sum("tokens")).first()[0]
    assert abs(got_ - 0.01 * total) <= 5 and seen[0][1] == 20_000 and seen[0][0] < 400


def test_draws_are_those_of_one_order(spark):
    """Against the plain way: all documents of a source in order, up to the budget."""
    rows = [(f"m{i % 2}", i, "s", 1 + i % 7, 0, 0.3 if i % 5 else 0.0, 60.0, None if i % 5 == 0 else ((i * 37) % 101) / 30) for i in range(300)]
    each = spark.createDataFrame(rows, "mix_name string, doc_id bigint, source string, tokens bigint, times int, chance double, budget double, _x double")
    want = set()
    for name in ("m0", "m1"):
        at = 0
        for r in sorted((r for r in rows if r[0] == name and r[7] is not None), key=lambda r: (r[7], r[1])):
            if at + r[3] / 2 <= 60.0:
                want.add(r[1])
            at += r[3]
    for steps in (1, 4, 1000):
        out = mix.by_chance(each, steps)
        assert out.count() == 300 and {r.doc_id for r in out.filter("_more = 1").collect()} == want
