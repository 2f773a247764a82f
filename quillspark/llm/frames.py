"""The text operators on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import abuse, markup, quality
from quillspark.llm import split as splitting
from quillspark.llm.arrow import latest, map_rows, spread


#: Documents scored in one step.
SCORED_ROWS = 500


def latest_names(tokens: DataFrame) -> DataFrame:
    """(page_id, node_id, name) of the latest row per key that has a name; null, empty and blank names are left out."""
    # Names of all rows take part, as a null name may be the latest.
    return latest(tokens.select("page_id", "node_id", "name", "loaded_at"), ["page_id", "node_id"], "loaded_at", "name").filter(F.trim("name") != "")


def markup_kinds(documents: DataFrame, tokens: DataFrame, pages: tuple[str, ...] = markup.LABELLED_PAGES) -> DataFrame:
    """(src, rec_id, node_id, kind): the notations of which a document or a token's name holds a segment that scores as markup.

    ``pages`` are the labelled pages that the scores are fitted on.
    """

    def texts():  # noqa: ANN202
        return lambda doc, text: ((doc, k) for k in sorted(markup.analyse(text, pages).kinds))

    def names():  # noqa: ANN202
        kinds = lru_cache(maxsize=1 << 16)(lambda name: tuple(sorted(markup.analyse(name, pages).kinds)))
        return lambda page, node, name: ((page, node, k) for k in kinds(name))

    docs = map_rows(spread(documents.select("doc_id", "text").filter(F.trim("text") != "")), texts, "rec_id bigint, kind string").distinct()
    toks = map_rows(latest_names(tokens), names, "rec_id bigint, node_id int, kind string")
    return docs.select(F.lit("documents").alias("src"), "rec_id", F.lit(-1).alias("node_id"), "kind").unionByName(toks.select(F.lit("tokens").alias("src"), "rec_id", "node_id", "kind"))


def markup_segments(documents: DataFrame, pages: tuple[str, ...] = markup.LABELLED_PAGES) -> DataFrame:
    """(doc_id, kind, start, end, score): of every document and notation the segment that is most markup."""
    make = lambda: lambda doc, text: ((doc, k, *v) for k, v in sorted(markup.analyse(text, pages).kinds.items()))
    return map_rows(spread(documents.select("doc_id", "text")), make, "doc_id bigint, kind string, start int, end int, score double")


def clean_documents(documents: DataFrame, pages: tuple[str, ...] = markup.LABELLED_PAGES) -> DataFrame:
    """(doc_id, clean_text, region_start, region_end, region_score, tags, tags_in_region): clean text and the content region it is made from."""

    def make():  # noqa: ANN202
        def one(doc: int, text: str | None) -> Iterator[tuple]:
            x = markup.analyse(text, pages)
            yield (doc, markup.clean(text, pages), *(x.region or (None, None, None)), x.tags, x.tags_in_region)

        return one

    return map_rows(spread(documents.select("doc_id", "text")), make, "doc_id bigint, clean_text string, region_start int, region_end int, region_score double, tags int, tags_in_region int")


def clean_names(tokens: DataFrame, pages: tuple[str, ...] = markup.LABELLED_PAGES) -> DataFrame:
    """(page_id, node_id, name, clean_name) of the names that cleaning changes."""

    def make():  # noqa: ANN202
        clean = lru_cache(maxsize=1 << 16)(lambda name: markup.clean(name, pages))
        return lambda page, node, name: iter([(page, node, name, c)] if (c := clean(name)) != name.strip() else [])

    return map_rows(latest_names(tokens), make, "page_id bigint, node_id int, name string, clean_name string")


def document_statistics(documents: DataFrame) -> DataFrame:
    """Statistics and form of every document, one row per row."""
    return map_rows(spread(documents.select("doc_id", "text")), lambda: lambda doc, text: iter([(doc, *quality.statistics(text))]), "doc_id bigint, " + quality.STATS_DDL)


def name_statistics(tokens: DataFrame) -> DataFrame:
    """Short statistics of the latest names: length, words, shares of letters and digits, readable or not."""

    def make():  # noqa: ANN202
        readable = lru_cache(maxsize=1 << 16)(quality.readable_name)
        return lambda page, node, name: iter([(page, node, name, readable(name))])

    rows = map_rows(latest_names(tokens), make, "page_id bigint, node_id int, name string, readable boolean")
    n = F.length("name")
    return rows.select(
        "page_id", "node_id", n.alias("n_chars"), F.size(F.regexp_extract_all("name", F.lit("(\\p{L}+)"), 1)).alias("n_words"),
        F.round(F.length(F.regexp_replace("name", "[^\\p{L}]", "")) / n, 4).alias("alpha_share"), F.round(F.length(F.regexp_replace("name", "[^0-9]", "")) / n, 4).alias("digit_share"), "readable",
    )


def forms(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """(src, rec_id, node_id, form) of documents that are no prose and of unreadable names of four or more characters."""

    def texts():  # noqa: ANN202
        return lambda doc, text: iter([(doc, f)] if (f := quality.document_form(text)) not in (None, "prose") else [])

    def names():  # noqa: ANN202
        readable = lru_cache(maxsize=1 << 16)(quality.readable_name)
        return lambda page, node, name: iter([] if readable(name) else [(page, node)])

    docs = map_rows(spread(documents.select("doc_id", "text").filter(F.trim("text") != "")), texts, "rec_id bigint, form string").distinct()
    toks = map_rows(latest_names(tokens).filter(F.length("name") >= 4), names, "rec_id bigint, node_id int")
    return docs.select(F.lit("documents").alias("src"), "rec_id", F.lit(-1).alias("node_id"), "form").unionByName(toks.select(F.lit("tokens").alias("src"), "rec_id", "node_id", F.lit("junk").alias("form")))


def oversized_sections(sections: DataFrame, limit: int = 2000) -> DataFrame:
    """(page_id, section_ix, cut): the coarsest kind of cut that brings each oversized text under the limit."""
    # A short text only supersedes: its row is carried without the text, and only long texts reach Python.
    rows = sections.select("page_id", "section_ix", F.when(F.length("text") > limit, F.col("text")).alias("text"), "loaded_at", F.xxhash64("level", "text").alias("_m"))
    long_ = latest(rows, ["page_id", "section_ix"], "loaded_at", "text", "_m").filter(F.col("text").isNotNull())
    return map_rows(long_, lambda: lambda page, ix, text: iter([(page, ix, c)] if (c := splitting.coarsest(text, limit)) else []), "page_id bigint, section_ix int, cut string")


def section_pieces(sections: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(page_id, section_ix, level, piece_ix, start, body, end, cut, text): pieces of every section's text, in order."""
    rows = sections.select("page_id", "section_ix", F.struct("level", "text").alias("v"), "loaded_at", F.xxhash64("level", "text").alias("_m"))
    one = latest(rows, ["page_id", "section_ix"], "loaded_at", "v", "_m").select("page_id", "section_ix", "v.level", "v.text")

    def make():  # noqa: ANN202
        def cut(page: int, ix: int, level: int | None, text: str | None) -> Iterator[tuple]:
            for k, p in enumerate(splitting.pieces(text or "", limit, overlap)):
                yield (page, ix, level, k, p.start, p.body, p.end, p.level, text[p.start : p.end])

        return cut

    return map_rows(one, make, "page_id bigint, section_ix int, level int, piece_ix int, start int, body int, end int, cut string, text string")


#: The last models by the rows they were trained on, so that queries over the same labels train once.
_MODELS: dict[int, abuse.Model] = {}


def labelled_documents(documents: DataFrame, labels: DataFrame) -> list[tuple[str, str]]:
    """(text, label) of at most MAX_LABELLED documents, chosen by hash of the id, whose reviewers mostly agree."""
    votes = labels.select("doc_id", F.lower(F.trim("label")).alias("label")).filter(F.col("label").isin("ok", *abuse.KINDS)).groupBy("doc_id", "label").count()
    best = votes.groupBy("doc_id").agg(F.max("count").alias("m"), F.sum("count").alias("n"), F.max_by("label", F.struct("count", "label")).alias("label")).filter(F.col("m") * 2 > F.col("n"))
    chosen = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(abuse.MAX_LABELLED).select("doc_id", "label")
    # Bounded by the parameter above; repeated rows of a document count once.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["label"]) for r in rows]


def train_abuse(documents: DataFrame, labels: DataFrame) -> abuse.Model:
    """The model, trained on ``labelled_documents``."""
    labelled = labelled_documents(documents, labels)
    key = hash(tuple(labelled))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = abuse.train(labelled)
    return _MODELS[key]


def abuse_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): scores of every document."""
    model = documents.sparkSession.sparkContext.broadcast(train_abuse(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for a in range(0, b.num_rows, SCORED_ROWS):
                part = b.slice(a, SCORED_ROWS)
                scores = m.document_scores(part.column(2).to_pylist()).astype("float64").round(6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, scores.T)], names=["doc_id", "source", *abuse.KINDS])

    rows = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, " + ", ".join(f"{k} double" for k in abuse.KINDS))
