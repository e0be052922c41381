"""Problem 1: results per key where a few keys hold most rows.

Counts and quantiles per key are made from mergeable counts only.

A quantile is found by refining a histogram: values are mapped to 64-bit integers that sort alike,
each round counts, per key, the values under 256 sub-ranges of the range that holds
the wanted rank, and keeps the sub-range with the rank, until a range has one value.
Rows are combined before every shuffle, so a key with a third of all rows sends as
many records as it has sub-ranges, never its values. Ranges of the few keys that
can hold more than 1/HOT of the rows reach the rows by broadcast (at most HOT keys, by
counting); the ranges of other keys by a join in which no key is large.

Keys with a given share of all events are selected alike: events are counted under 65,536 ranges of the
keys' hashes, ranges with less than the share are dropped (fewer than 1 / share are left), the others
are refined until each holds one key. So a key below the share is never sent by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize

#: A key is hot if it has more than 1/HOT of the rows; there are fewer than HOT of them.
HOT = 2000
#: Bits resolved per round: of values, of the hashes of keys.
DIGIT, KEY_DIGIT = 8, 16


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value as a long. Fractions have to be scaled to integers by the caller, so that no rank is lost."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        raise TypeError("quantiles are taken of integers; scale other values first")
    return value.cast("long")


def key_events(rows: DataFrame, fields: Sequence[str], event: str, value: str | None = None) -> DataFrame:
    """``(f, k, v)``: one row per field ``f`` (its number, from 0), key and event, with the event's smallest value there;
    and one per event with the number after the last and a null key. Rows without an event are dropped.

    Fields are grouping sets of one scan. The pair (key, event) is made distinct, so a hot key is spread by its events.
    """
    picked = rows.where(F.col(event).isNotNull()).select(
        *[F.col(c).cast("string").alias(f"k{n}") for n, c in enumerate(fields)], F.col(event).alias("ev"),
        (_ordered(F.col(value), rows.schema[value].dataType) if value else F.lit(None).cast("long")).alias("v"))
    keys = [f"k{n}" for n in range(len(fields))]
    once = picked.groupingSets([*[(k, "ev") for k in keys], ("ev",)], *keys, "ev").agg(F.grouping_id().alias("g"), F.min("v").alias("v"))
    # the grouping id has a bit for every key that is left out, the first key the highest
    every = (1 << len(keys)) - 1
    number, key = F.lit(len(keys)), F.lit(None).cast("string")
    for n, k in enumerate(keys):
        own = F.col("g") == ((every ^ (1 << (len(keys) - 1 - n))) << 1)
        number, key = F.when(own, n).otherwise(number), F.when(own, F.col(k)).otherwise(key)
    return once.select(number.cast("int").alias("f"), key.alias("k"), "v")


def event_histogram(rows: DataFrame, key: str, event: str, value: str) -> DataFrame:
    """``(k, v, n)``: the smallest values of a key's distinct events. The null key is a key, null values are kept."""
    return key_events(rows, [key], event, value).where("f = 0").select("k", "v", F.lit(1).cast("long").alias("n"))


def value_histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(k, v, n)`` of all rows."""
    return rows.groupBy(F.col(key).cast("string").alias("k"), _ordered(F.col(value), rows.schema[value].dataType).alias("v")).agg(F.count("*").alias("n"))


def key_quantiles(rows: DataFrame, key: str, value: str, fractions: Sequence[float], event: str | None = None, hot: int = HOT) -> DataFrame:
    """``(k, n, q, v)``: exact lower quantiles (the value of rank ceil(q * n), at least 1) of an
    integer value per key; ties count as often as they come.

    Null values don't count; a key with null values only has no row; the null key is a key like
    others. With ``event``, each (key, event) counts once, with its smallest value. Results equal
    sorting the values of each key; no task ever holds them.
    """
    base = event_histogram(rows, key, event, value) if event else value_histogram(rows, key, value)
    return histogram_quantiles(materialize(base, "skew-histogram"), fractions, hot)


def histogram_quantiles(base: DataFrame, fractions: Sequence[float], hot: int = HOT) -> DataFrame:
    """The same from a stored histogram ``(k, v, n)``."""
    base = base.where("v is not null")
    span = materialize(base.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("records"), F.min("v").alias("lo"), F.max("v").alias("hi")), "skew-span")
    records = span.agg(F.sum("records")).first()[0] or 0
    heavy = span.where(F.col("records") > records / hot).select("k")  # fewer than ``hot`` keys
    wanted = span.withColumn("q", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round(F.col("q") * F.col("n"), 9)).cast("long"))))
    # widths of the sub-ranges are powers of two; ranges are aligned to them
    state = materialize(wanted.select("k", "n", "q", "rank", "lo", "hi"), "skew-state")
    done = None
    while True:
        open_ = state.where("lo < hi")
        closed = state.where("lo = hi").select("k", "n", "q", F.col("lo").alias("v"))
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            return done
        state = materialize(_refine(base, open_, heavy), "skew-state")


def _refine(base: DataFrame, open_: DataFrame, heavy: DataFrame) -> DataFrame:
    """One round: each open range is replaced with its sub-range that holds the rank."""
    span = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1
    shift = F.greatest(F.lit(0), F.ceil(F.log2(span.cast("double"))).cast("int") - DIGIT)
    ranges = open_.select("k", "lo", "hi").distinct().withColumn("shift", shift)
    heavy = F.broadcast(heavy)
    null_safe = lambda a, b: a["k"].eqNullSafe(b["k"])
    hot_ranges = F.broadcast(ranges.join(heavy, null_safe(ranges, heavy), "left_semi"))
    cold_ranges = ranges.join(heavy, null_safe(ranges, heavy), "left_anti")
    cold_rows = base.join(heavy, null_safe(base, heavy), "left_anti")

    def counted(rows: DataFrame, own: DataFrame) -> DataFrame:
        a, b = rows.alias("a"), own.alias("b")
        hits = a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")) & F.col("a.v").between(F.col("b.lo"), F.col("b.hi")))
        digit = F.expr("shiftright(cast(cast(a.v as decimal(20,0)) - cast(b.lo as decimal(20,0)) as bigint), b.shift)")
        return hits.groupBy(F.col("b.k").alias("k"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.col("b.shift").alias("shift"), digit.alias("digit")).agg(F.sum("a.n").alias("m"))

    counts = counted(base, hot_ranges).unionByName(counted(cold_rows, cold_ranges))
    from pyspark.sql import Window

    upto = Window.partitionBy("k", "lo", "hi").orderBy("digit")
    counts = counts.withColumn("upto", F.sum("m").over(upto)).withColumn("before", F.col("upto") - F.col("m"))
    # values below a range count for its rank already: the rank is relative to the range
    a, b = open_.alias("a"), counts.alias("b")
    same = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    chosen = a.join(b, same & (F.col("a.rank") > F.col("b.before")) & (F.col("a.rank") <= F.col("b.upto")))
    low = F.expr("a.lo + shiftleft(b.digit, b.shift)")
    return chosen.select(
        F.col("a.k").alias("k"), F.col("a.n").alias("n"), F.col("a.q").alias("q"), (F.col("a.rank") - F.col("b.before")).alias("rank"),
        low.alias("lo"), F.least(F.col("a.hi"), low + F.expr("shiftleft(1L, b.shift) - 1")).alias("hi"),
    )


def key_profile(rows: DataFrame, fields: Sequence[str], event: str, value: str, fractions: Sequence[float] = (0.5,)) -> DataFrame:
    """``(field, key_value, n_events, total_events, q, v)``: distinct events of every non-null key of
    every field, with exact quantiles of a value (null where a key has no value). ``total_events``
    counts distinct events whatever their keys. All fields share one scan and each round."""
    events = materialize(key_events(rows, fields, event, value), "skew-events")
    total = events.where(F.col("f") == len(fields)).count()
    # field and key as one text: the number of the field, a blank, the key
    base = events.where((F.col("f") < len(fields)) & F.col("k").isNotNull()).select(F.concat_ws(" ", "f", "k").alias("k"), "v", F.lit(1).cast("long").alias("n"))
    counts = base.groupBy("k").agg(F.sum("n").alias("n"))
    quantiles = histogram_quantiles(base, fractions).select(F.col("k").alias("qk"), "q", "v")
    name = F.element_at(F.array(*map(F.lit, fields)), F.substring_index("k", " ", 1).cast("int") + 1)
    return counts.join(quantiles, F.col("k") == F.col("qk"), "left").select(
        name.alias("field"), F.expr("substring(k, instr(k, ' ') + 1)").alias("key_value"), F.col("n").alias("n_events"), F.lit(total).cast("long").alias("total_events"), "q", "v")


def heavy_keys(rows: DataFrame, fields: Sequence[str], event: str, share: float = 0.02) -> DataFrame:
    """``(field, key_value, n_events)``: non-null keys with at least ``share`` of all distinct events, events of the null key included
    in these. No events, no keys."""
    spark = rows.sparkSession
    events = materialize(key_events(rows, fields, event).select("f", "k"), "skew-events")
    least = share * events.where(F.col("f") == len(fields)).count()
    hashed = events.where((F.col("f") < len(fields)) & F.col("k").isNotNull()).select("f", "k", F.xxhash64("k").alias("h"))
    found, open_ = [], None
    for bits in range(KEY_DIGIT, 65, KEY_DIGIT):
        inside = hashed if open_ is None else hashed.join(F.broadcast(open_), (F.col("f") == F.col("of")) & (F.shiftrightunsigned("h", 64 - bits + KEY_DIGIT) == F.col("or")), "left_semi")  # fewer than fields / share ranges
        ranges = inside.groupBy("f", F.shiftrightunsigned("h", 64 - bits).alias("r")).agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))
        kept = ranges.where(F.col("n") >= least).collect()  # fewer than fields / share rows
        found += [(r.f, r.a, r.n) for r in kept if r.a == r.b]
        several = [(r.f, r.r) for r in kept if r.a != r.b]
        if not several:
            break
        open_ = spark.createDataFrame(several, "of int, or long")
    else:  # keys that share all bits of their hash
        same = hashed.join(F.broadcast(open_), (F.col("f") == F.col("of")) & (F.col("h") == F.col("or")), "left_semi")
        found += [tuple(r) for r in same.groupBy("f", "k").count().where(F.col("count") >= least).collect()]
    return spark.createDataFrame([(fields[f], k, n) for f, k, n in found], "field string, key_value string, n_events long")
