"""Queries of the text operators: name to function of (spark, data folder), and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import abuse, frames, mix, pack
from quillspark.llm.tokens import with_token_counts
from quillspark.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frames.markup_kinds(table(spark, d, "documents"), table(spark, d, "tokens"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return frames.clean_documents(table(spark, d, "documents"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return frames.markup_segments(table(spark, d, "documents"))


def p2_clean_names(spark: SparkSession, d: str) -> DataFrame:
    return frames.clean_names(table(spark, d, "tokens"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return frames.forms(table(spark, d, "documents"), table(spark, d, "tokens"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return frames.document_statistics(table(spark, d, "documents"))


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    return frames.name_statistics(table(spark, d, "tokens"))


def _limit(spark: SparkSession, d: str, limit_id: int) -> tuple[int, int]:
    r = table(spark, d, "size_limits").filter(F.col("limit_id") == limit_id).select("capacity", F.coalesce("overlap_size", F.lit(0))).first()
    return int(r[0]), int(r[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frames.oversized_sections(table(spark, d, "sections"), _limit(spark, d, 1)[0])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return frames.section_pieces(table(spark, d, "sections"), *_limit(spark, d, 1))


def p4_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """Per section a digest of its pieces' bodies put together, without blanks, and whether the pieces keep the limit and the overlap."""
    limit, overlap = _limit(spark, d, 1)
    p = frames.section_pieces(table(spark, d, "sections"), limit, overlap)
    body = F.struct("piece_ix", F.expr("substring(text, body - start + 1)").alias("b"), (F.col("body") - F.col("start")).alias("o"))
    rows = p.groupBy("page_id", "section_ix").agg(F.sort_array(F.collect_list(body)).alias("p"), F.max(F.length("text")).alias("longest"))
    whole = F.array_join(F.transform("p", lambda x: x["b"]), "")
    # The overlap is whole unless the piece before is shorter.
    repeated = F.forall(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: (x["o"] > 0) | (x["piece_ix"] == 0))
    return rows.select("page_id", "section_ix", F.md5(F.regexp_replace(whole, "[ \\t\\r\\n]", "")).alias("digest"), (F.col("longest") <= limit).alias("within"), repeated.alias("repeated"))


def _sized(documents: DataFrame) -> DataFrame:
    return with_token_counts(documents, {"doc_id": "bigint"})


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"), [(i, _limit(spark, d, i)[0]) for i in (2, 3)], _sized)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.report(p6_packing(spark, d))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per limit what must not be: overfull containers, divided documents that would fit, tokens lost, room left; and the documents placed."""
    docs = table(spark, d, "documents")
    packed = cut(p6_packing(spark, d))
    boxes = packed.groupBy("limit_id", "capacity", "container_id").agg(F.sum("tokens").alias("t"))
    full = boxes.filter("container_id is not null").groupBy("limit_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), (F.sum("t") / F.sum("capacity") >= 0.97).alias("well_filled"))
    whole = packed.groupBy("limit_id", "capacity").agg(F.count_if(F.col("piece_ix") == 0).alias("documents"), F.count_if((F.col("piece_ix") > 0) & F.col("container_id").isNull()).alias("unplaced"), F.sum("tokens").alias("_t"))
    sized = _sized(docs).agg(F.sum("tokens").alias("_all"))
    return whole.join(full, "limit_id").join(F.broadcast(sized), F.col("_t") == F.col("_all"), "left").select("limit_id", "documents", "overfull", "unplaced", "well_filled", F.col("_all").isNull().alias("tokens_lost"))


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keep = {"doc_id": "bigint", "source": "string", "lang": "string", "topic": "string"}
    return mix.draw(table(spark, d, "documents"), table(spark, d, "mixtures"), lambda x: with_token_counts(x, keep))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    drawn, sized = _drawn(spark, d)
    return mix.shares(drawn, sized, table(spark, d, "mixtures"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source what must not be: repeats above the cap, sources of no weight drawn, and shares off the
    target by more than a hundredth although the source is neither capped nor empty and no other one fell short."""
    s = p7_shares(spark, d)
    capped = F.col("max_repeats").isNotNull() & (F.col("drawn_tokens") >= 0.98 * F.col("max_repeats") * F.col("tokens_at_hand"))
    short = s.groupBy("mix_name").agg(F.max((capped | (F.col("tokens_at_hand") == 0)).cast("int")).alias("_short"))
    off = (F.col("_short") == 0) & (F.abs(F.col("target_share") - F.col("actual_share")) > 0.01)
    return s.join(short, "mix_name").select(
        "mix_name", "source", F.coalesce(F.col("most_repeats") > F.col("max_repeats"), F.lit(False)).alias("over_cap"), ((F.col("target_share") == 0) & (F.col("drawn_tokens") > 0)).alias("unwanted"), off.alias("off_target")
    )


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return frames.abuse_scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).drop("source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(F.col(k) >= abuse.THRESHOLD, F.lit(k)) for k in abuse.KINDS]))
    return _scores(spark, d).select("doc_id", F.explode(kinds).alias("kind")).distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).groupBy(F.coalesce(mix.plain_source(F.col("source")), F.lit("unknown")).alias("source"))
    return rows.agg(F.count("*").alias("documents"), *[F.round(F.avg((F.col(k) >= abuse.THRESHOLD).cast("int")), 6).alias(f"{k}_rate") for k in abuse.KINDS])


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """(label, documents, found): labelled documents scored by models that have not seen them."""
    rows = abuse.held_out(frames.labelled_documents(table(spark, d, "documents"), table(spark, d, "review_labels")))
    return spark.createDataFrame(rows, "label string, documents bigint, found bigint")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_segments, p2_clean, p2_clean_names, p3_found, p3_statistics, p3_names, p4_found, p4_pieces, p4_reassembled, p6_packing, p6_report, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_scores, p8_rates, p8_held_out)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    edge = r"' ' || chr(9) || chr(13) || chr(10)"
    big = lambda parts: f"list_max(list_transform({parts}, lambda x: length(trim(x, {edge})))) <= 2000"
    eq = "|".join(f"={{{n}}}(?:[^=\\n]|[^=\\n][^\\n]*[^=\\n])={{{n}}}|={{{n}}}" for n in range(2, 7))
    # Lines are numbered, so that each rule is a test of whole lines.
    return {
        "p6_checks": "SELECT limit_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS unplaced, true AS well_filled, false AS tokens_lost FROM size_limits WHERE limit_id IN (2, 3)",
        "p7_checks": "SELECT DISTINCT mix_name, regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g') AS source, false AS over_cap, false AS unwanted, false AS off_target FROM mixtures",
        "p4_reassembled": f"""
            WITH s AS (SELECT page_id, section_ix, arg_max(text, (loaded_at, hash(text))) AS text FROM sections GROUP BY ALL)
            SELECT page_id, section_ix, md5(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) AS digest, true AS within, true AS repeated FROM s WHERE trim(text, {edge}) <> ''""",
        "p4_found": f"""
            WITH s AS (SELECT page_id, section_ix, arg_max(text, (loaded_at, hash(text))) AS raw FROM sections GROUP BY ALL),
            t AS (SELECT page_id, section_ix, trim(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {edge}) AS text, trim(raw, {edge}) AS raw FROM s),
            l AS (SELECT *, string_split(text, chr(10)) AS lines FROM t WHERE length(raw) > 2000),
            m AS (SELECT *, list_transform(lines, lambda x: CASE WHEN regexp_full_match(rtrim(x, ' ' || chr(9)), '{eq}') THEN chr(1) || x ELSE x END) AS heads FROM l),
            h AS (SELECT *, list_transform(heads, lambda x: CASE WHEN trim(x, ' ' || chr(9)) = '' THEN chr(1) ELSE x END) AS paras FROM m),
            c AS (SELECT page_id, section_ix,
                {big("string_split(array_to_string(heads, chr(10)), chr(1))")} AS h1,
                {big("string_split(array_to_string(paras, chr(10)), chr(1))")} AS h2,
                {big("lines")} AS h3,
                {big("string_split_regex(text, '[ \\t\\n]')")} AS h4 FROM h)
            SELECT page_id, section_ix, CASE WHEN h1 THEN 'heading' WHEN h2 THEN 'paragraph' WHEN h3 THEN 'line' WHEN h4 THEN 'word' ELSE 'none' END AS cut FROM c""",
    }
