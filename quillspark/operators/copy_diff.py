"""Differences between two copies of the same keyed rows.

Each copy is summed up by itself: a checksum and a count per narrow key range, from which those
of wider ranges follow. Only these sums are compared, from the widest ranges down: a range whose
sums agree is dropped with everything below it, a range that differs is split into its narrower
ranges. Rows are opened at the source in the narrowest ranges that are left, and only those
are compared field by field. Two equal copies are told by their sums; no row is opened.

Defined results for awkward input: null key parts are one key value; of the rows with one
key only the latest counts (a null time is earliest, further ties go to the larger
checksum); repeated rows count once; empty copies give a table of missing rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

#: The narrowest range holds this many bits of the second key, at most 16 keys.
LEAF_BITS = 4
#: (bits of the second key, bits of the first key) that a level drops, narrowest first; None: the whole second key.
#: A step down halves a range four to eight times at once.
LEVELS: tuple[tuple[int | None, int], ...] = ((LEAF_BITS, 0), (8, 0), (None, 0), (None, 6), (None, 12), (None, 20))
#: Narrowest ranges that differ are broadcast to the copies up to this many (16 bytes each), joined by shuffle above.
BROADCAST_RANGES = 500_000
#: So many stretches of the first key are told to the scan of the source, so that it skips what lies outside; more become one.
STRETCHES, STRETCH_BITS = 64, 12


@dataclass(frozen=True)
class Field:
    """A compared field: its name in the report and its value, normalised so that equal values are equal columns."""

    name: str
    value: Column


def blank_to_null(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def token_fields() -> list[Field]:
    """The compared fields of token rows; null, empty string, empty list and false are one value at every depth."""
    child = F.transform(
        F.col("children"),
        lambda x: F.when(
            x.isNotNull(),
            F.struct(F.nullif(x["is_text"], F.lit(False)).alias("is_text"), blank_to_null(x["text"]).alias("text"), x["node_id"].alias("node_id")),
        ),
    )
    return [
        Field("name", blank_to_null(F.col("name"))),
        Field("children", F.when(F.size("children") > 0, child)),
        Field("type", blank_to_null(F.col("type"))),
        Field("subtype", blank_to_null(F.col("subtype"))),
        Field("level", F.col("payload")["level"]),
    ]


def _checksum(fields: Sequence[Field]) -> Column:
    # to_json keeps the place of nulls, which a plain hash of the columns would skip.
    return F.xxhash64(F.to_json(F.struct(*[f.value.alias(f.name) for f in fields]), {"ignoreNullFields": "false"}))


def _keys(df: DataFrame, keys: tuple[str, str], version: str, extra: Sequence[Column]) -> DataFrame:
    return df.select(
        F.col(keys[0]).cast("bigint").alias("_k1"),
        F.col(keys[1]).cast("bigint").alias("_k2"),
        F.coalesce(F.col(version).cast("timestamp").cast("double"), F.lit(float("-inf"))).alias("_v"),
        *extra,
    )


def copy_sums(df: DataFrame, keys: tuple[str, str], version: str, fields: Sequence[Field]) -> DataFrame:
    """(_k1, _r, sum, n): checksum and count of one copy's latest rows per narrowest range.

    Ranges are spread by hash, so one huge first key is still split over all tasks; the whole
    step is a single shuffle of narrow rows.
    """
    rows = _keys(df, keys, version, [_checksum(fields).alias("_h")])
    rows = rows.withColumn("_r", F.shiftright("_k2", LEAF_BITS)).repartition("_k1", "_r")
    once = rows.groupBy("_k1", "_r", "_k2", "_v").agg(F.max("_h").alias("_h"))
    latest = once.groupBy("_k1", "_r", "_k2").agg(F.max_by("_h", "_v").alias("_h"))
    # The key goes into the checksum, so that two rows that swap values are seen.
    return latest.groupBy("_k1", "_r").agg(F.bit_xor(F.xxhash64("_k1", "_k2", "_h")).alias("sum"), F.count("*").alias("n"))


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_k1, _r, sum_left, sum_right, n_left, n_right): the sums of both copies per narrowest range."""
    zero = F.lit(0).cast("bigint")
    rows = left.select("_k1", "_r", F.col("sum").alias("sum_left"), zero.alias("sum_right"), F.col("n").alias("n_left"), zero.alias("n_right"))
    return rows.unionByName(right.select("_k1", "_r", zero.alias("sum_left"), F.col("sum").alias("sum_right"), zero.alias("n_left"), F.col("n").alias("n_right"))).groupBy("_k1", "_r").agg(*_totals())


def _totals() -> list[Column]:
    return [*[F.bit_xor(c).alias(c) for c in ("sum_left", "sum_right")], *[F.sum(c).alias(c) for c in ("n_left", "n_right")]]


def checksum_levels(leaves: DataFrame) -> list[DataFrame]:
    """The checksums of every level, narrowest first; each is summed up from the one below."""
    levels = [leaves]
    for level in range(1, len(LEVELS)):
        bits2, bits1 = LEVELS[level]
        below2, below1 = LEVELS[level - 1]
        k2 = F.lit(None).cast("bigint") if bits2 is None else F.shiftright("_r", bits2 - below2)
        up = levels[-1].select(F.shiftright("_k1", bits1 - below1).alias("_k1"), k2.alias("_r"), "sum_left", "sum_right", "n_left", "n_right")
        levels.append(up.groupBy("_k1", "_r").agg(*_totals()))
    return levels


def _unequal(df: DataFrame) -> DataFrame:
    return df.filter((F.col("sum_left") != F.col("sum_right")) | (F.col("n_left") != F.col("n_right")))


def open_ranges(leaves: DataFrame) -> DataFrame:
    """(_k1, _r): the narrowest ranges that differ, found from the widest ranges down."""
    levels = checksum_levels(leaves)
    found = _unequal(levels[-1]).select("_k1", "_r")
    for level in range(len(LEVELS) - 2, -1, -1):
        bits2, bits1 = LEVELS[level + 1]
        own2, own1 = LEVELS[level]
        up = found.select(F.col("_k1").alias("_u1"), F.col("_r").alias("_u2"))
        k2 = F.lit(None).cast("bigint") if bits2 is None else F.shiftright("_r", bits2 - (own2 or 0))
        inside = F.shiftright(F.col("_k1"), bits1 - own1).eqNullSafe(F.col("_u1")) & k2.eqNullSafe(F.col("_u2"))
        # What lies in a range that agrees is not looked at.
        found = _unequal(levels[level].join(up, inside, "left_semi")).select("_k1", "_r")
    return found


def _within(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Rows in the stretches of the first key that the ranges lie in, as a filter that the scan can use."""
    stretches = ranges.select(F.shiftright("_k1", STRETCH_BITS)).distinct().limit(STRETCHES + 1).collect()
    if len(stretches) <= STRETCHES:
        spans = [(r[0] << STRETCH_BITS, ((r[0] + 1) << STRETCH_BITS) - 1) for r in sorted(r for r in stretches if r[0] is not None)]
        with_null = len(spans) < len(stretches)
    else:
        lo, hi, nulls = ranges.agg(F.min("_k1"), F.max("_k1"), F.count_if(F.col("_k1").isNull())).first()
        spans, with_null = ([] if lo is None else [(lo, hi)]), nulls > 0
    keep = F.col(key).isNull() if with_null else F.lit(False)
    for lo, hi in spans:
        keep |= F.col(key).between(lo, hi)
    return df.filter(keep)


def opened(df: DataFrame, keys: tuple[str, str], version: str, fields: Sequence[Field], ranges: DataFrame) -> DataFrame:
    """(_k1, _k2, value): the latest rows of one copy in these ranges, read from the source."""
    wanted = ranges.select(F.col("_k1").alias("_w1"), F.col("_r").alias("_w2"))
    raw = _keys(_within(df, keys[0], ranges), keys, version, [f.value.alias(f"_f_{f.name}") for f in fields])
    rows = raw.join(wanted, raw["_k1"].eqNullSafe(wanted["_w1"]) & F.shiftright(raw["_k2"], LEAF_BITS).eqNullSafe(wanted["_w2"]), "left_semi")
    value = F.struct(*[F.col(f"_f_{f.name}").alias(f.name) for f in fields])
    mark = F.xxhash64(F.to_json(value, {"ignoreNullFields": "false"}))
    return rows.groupBy("_k1", "_k2").agg(F.max_by(value, F.struct("_v", mark)).alias("value"))


def diff_copies(left: DataFrame, right: DataFrame, keys: tuple[str, str], version: str, fields: Sequence[Field]) -> DataFrame:
    """(k1, k2, field): ``missing_left``, ``missing_right`` or the name of a field whose values differ."""
    # Checkpointed, as the walk reads the sums once per level and both copies are opened by its ranges.
    ranges = cut(open_ranges(cut(side_by_side(copy_sums(left, keys, version, fields), copy_sums(right, keys, version, fields)))))
    n = ranges.count()
    if not n:
        return left.sparkSession.createDataFrame([], "k1 bigint, k2 bigint, field string")
    if n <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    a = opened(left, keys, version, fields, ranges).withColumnRenamed("value", "a")
    b = opened(right, keys, version, fields, ranges).select(F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2"), F.col("value").alias("b"))
    pairs = a.join(b, a["_k1"].eqNullSafe(b["_b1"]) & a["_k2"].eqNullSafe(b["_b2"]), "full")
    # A row's value is a struct, null only where the copy has no such row.
    flags = F.array_compact(F.array(*[F.when(~F.col(f"a.{f.name}").eqNullSafe(F.col(f"b.{f.name}")), F.lit(f.name)) for f in fields]))
    what = F.when(F.col("a").isNull(), F.array(F.lit("missing_left"))).when(F.col("b").isNull(), F.array(F.lit("missing_right"))).otherwise(flags)
    key = lambda x, y: F.when(F.col("a").isNull(), F.col(y)).otherwise(F.col(x))
    return pairs.select(key("_k1", "_b1").alias("k1"), key("_k2", "_b2").alias("k2"), F.explode(what).alias("field"))


def token_copy_diff(tokens: DataFrame, other: DataFrame) -> DataFrame:
    """(page_id, node_id, field) for two parsers' copies of the same token rows."""
    found = diff_copies(tokens, other, ("page_id", "node_id"), "loaded_at", token_fields())
    return found.select(F.col("k1").alias("page_id"), F.col("k2").cast("int").alias("node_id"), "field")
