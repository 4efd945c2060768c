"""Operator 6 [native], mixing sources to target weights along a time-varying curriculum.

A source's target is its share by weight of the corpus's words, at most `most` times its own words; what that cuts off is
shared again by weight (water filling, in closed form over the sources in order of cap for weight). Its schedule says when
in training its words are wanted: a weight that runs straight from `early` to `late`, whose integral is the target. Each
copy of a document demands the next stretch of its source's words; inverting the integral gives its position in training.
Documents are range-sorted by position.

Within a source, documents stand in order of the md5 of their id, then of a hash of the row. Rows equal in all columns are one
row with a count until the end. Running sums go by nested ranges of that order (first digits of the md5, the md5, first digits
of the row's hash): a window holds a range's rows, or one row for each range in the next wider one, so no task holds a source
or all rows of an id. The last copy is given to documents up to the one whose middle
is over the target.

Cases: null texts have size 0; a null source is a source of its own, the last; documents of size 0 are taken for 0 words; a
corpus without words has targets 0; repeated rows are each a document, and rows of one id are told apart by all their
columns; null ids are like any other; extra columns come through mix() untouched. Sources are expected to be few: windows over
them, one row each, are not split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from .common import staged, words_of

WEIGHTS = (1, 2, 3)
MOST = 3
#: Weight at the start and at the end of training, by place among the weights: early-heavy, even, late-heavy.
EARLY_LATE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
RANGE_ROWS = 1000
POSITIONS = 1_000_000_000


def sizes(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, key (the order within a source), h (a hash of all columns) and n: how many rows are equal."""
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("bigint").alias("size"), key.alias("key"), row_hash(df).alias("h"))
    return rows.groupBy("doc_id", "source", "size", "key", "h").agg(F.count("*").alias("n"))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which have no order."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)))


def targets(slim: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, place: a row for each source."""
    s = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # over sources
    s = s.withColumn("place", (rank % len(weights)).cast("int"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1)).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0))).cast("double") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0))))
    s = s.withColumn("level", F.coalesce(F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), "level"))).over(every)["level"], F.lit(0.0)))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"), "place")


def running(slim: DataFrame, rows: int) -> DataFrame:
    """slim with before: the words of the source's documents ahead of the first of each row's equals."""
    digits = 0
    while digits < 5 and rows > RANGE_ROWS * 16**digits:
        digits += 1
    ranged = slim.withColumn("amount", F.col("size") * F.col("n")).withColumns({"__r0": F.substring("key", 1, digits), "__r1": F.col("key"), "__r2": F.substring(F.lpad(F.hex("h"), 16, "0"), 1, digits)})
    return _ahead(ranged, ["source", "__r0", "__r1", "__r2"], [F.lpad(F.hex("h"), 16, "0"), F.col("doc_id"), F.col("size")]).drop("amount", "__r0", "__r1", "__r2")


def _ahead(rows: DataFrame, ranges: list[str], order: list[Column]) -> DataFrame:
    """rows with before: the sum of `amount` ahead of each in its first range's order. ranges: nested, the widest first."""
    within = F.sum("amount").over(Window.partitionBy(*ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("amount")
    dealt = rows.withColumn("before", within)
    if len(ranges) == 1:
        return dealt
    sums = _ahead(rows.groupBy(*ranges).agg(F.sum("amount").alias("amount")), ranges[:-1], [F.col(ranges[-1])])
    sums = sums.select(*(F.col(r).alias(f"__of{r}") for r in ranges), F.col("before").alias("__ahead"))
    on = F.lit(True)
    for r in ranges:
        on = on & F.col(r).eqNullSafe(F.col(f"__of{r}"))
    return dealt.join(sums, on).withColumn("before", F.col("before") + F.col("__ahead")).drop("__ahead", *(f"__of{r}" for r in ranges))


def _when(share: Column, early: Column, late: Column) -> Column:
    """The time at which a schedule from early to late has given out the share of its integral."""
    a, b = early, late - early
    return F.when(b == 0, share).otherwise((F.sqrt(a * a + b * share * (a + late)) - a) / b)


def plan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, early_late: tuple[tuple[float, float], ...] = EARLY_LATE) -> DataFrame:
    """A row for each row of df (of equal ones each has its own): doc_id, source, size, h, source_size, target, copies, taken, positions (one for each copy, in 0 ... POSITIONS)."""
    slim = staged(sizes(df, doc_id=doc_id, text=text, source=source), "sizes")
    of = staged(targets(slim, weights=weights, most=most), "targets").withColumnRenamed("source", "__source")
    rows = running(slim, slim.count())
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 1000)))  # in two steps, so that no array is long
    rows = rows.withColumn("__block", block).withColumn("__equal", F.explode(F.sequence(F.col("__block") * 1000, F.least(F.col("n"), F.col("__block") * 1000 + 1000) - 1)))
    rows = rows.withColumn("before", F.col("before") + F.col("__equal") * F.col("size")).drop("__block", "__equal", "n").join(of, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest) & (F.col("whole") < most)
    rows = rows.withColumn("whole", whole).withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(more, 1).otherwise(0)).cast("int"))
    early = F.element_at(F.array(*(F.lit(float(e)) for e, _ in early_late)), F.col("place") % len(early_late) + 1)
    late = F.element_at(F.array(*(F.lit(float(x)) for _, x in early_late)), F.col("place") % len(early_late) + 1)
    at = lambda k: F.least(F.lit(POSITIONS - 1), F.floor(F.lit(POSITIONS) * _when(F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("before") + k * F.col("source_size")) / F.col("target"))).otherwise(0.0), early, late)))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: at(k).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("doc_id", "source", "size", "h", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))


def in_order(rows: DataFrame, position: str, *others: str) -> DataFrame:
    """rows range-sorted by position."""
    return rows.repartitionByRange(position, *others).sortWithinPartitions(position, *others)


def mix(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", position: str = "position", **how: object) -> DataFrame:
    """The copies themselves, in order: df's columns and the position (which replaces a column of that name)."""
    planned = plan(df, doc_id=doc_id, text=text, source=source, **how)
    keyed = staged(planned.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("source").alias("__source"), F.explode("positions").alias("__at")), "plan")
    keep = [c for c in df.columns if c != position]
    # equal rows are one row here, whose copies have the positions of all of them
    rows = df.withColumn("__hash", row_hash(df)).groupBy(F.col(doc_id).alias("__key"), "__hash", F.col(source).alias("__of")).agg(*(F.first(f"`{c}`").alias(c) for c in keep))
    on = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")) & F.col("__of").eqNullSafe(F.col("__source"))
    return in_order(rows.join(keyed, on).select(*keep, F.col("__at").alias(position)), position, doc_id)
