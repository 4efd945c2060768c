"""Operator 5 [native], quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Unigrams and bigrams are hashed to BUCKETS buckets. The raw multinomial counts all texts; the trusted one counts all
documents labelled good, and is smoothed towards the raw one. A document's ratio is the sum of its n-grams' log ratios over
their number; documents below a fixed threshold, and those that fail the base rules, are not kept. All is built-in functions;
shuffles are of the labelled ids and of bucket counts, at most BUCKETS rows a task, and the table of ratios goes out as one
array of BUCKETS numbers. Where the labelled ids are too many for Spark to broadcast, texts move once to meet them.

Cases: null and empty texts have no words, fail the base rules and have ratio 0; repeated rows are each judged; without
trusted labels the ratio is 0 for all and the base rules decide; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words_of

BUCKETS = 1 << 14
#: Weight of the raw multinomial in the trusted one, in n-grams a bucket.
PRIOR = 8.0
#: Mean log ratio of an n-gram that a kept document has at least.
KEEP_FROM = -0.055
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(h: Column) -> Column:
    """Hashes of neighbours in h."""
    n = F.size(h)
    pairs = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(pairs)


def bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def window_hashes(h: Column, pairs: Column) -> Column:
    """Hashes of windows of three words; pairs: pair_hashes(h)."""
    n = F.size(h)
    threes = F.zip_with(F.slice(pairs, F.lit(1), n - 2), F.slice(h, F.lit(3), n - 2), lambda ab, c: F.xxhash64(ab, c))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(threes)


#: Bits of a sort key that hold a window's place; the others are its hash's.
PLACE = 24


def repeat_words(rows: DataFrame, threes: str, out: str) -> DataFrame:
    """rows with out: the words under the windows (a column of window_hashes()) that occur twice or more.

    Windows are sorted by hash and place packed in one number; neighbours are compared by their whole hashes. What a lambda
    reads is a column of its own, or it would be worked out for each element."""
    t, mask = F.col(threes), (1 << PLACE) - 1
    m = F.size(t)
    several = (F.size(F.array_distinct(t)) < m) & (m <= mask)
    keys = F.sort_array(F.transform(t, lambda v, i: v.bitwiseAND(~mask).bitwiseOR(i.cast("bigint"))))
    rows = rows.withColumn("__keys", F.when(several, keys))
    k = F.col("__keys")
    at = lambda x: F.get(t, x.bitwiseAND(mask).cast("int"))
    same = F.zip_with(F.slice(k, F.lit(1), m - 1), F.slice(k, F.lit(2), m - 1), lambda a, b: F.when((F.shiftright(a, PLACE) == F.shiftright(b, PLACE)) & (at(a) == at(b)), F.array(a.bitwiseAND(mask), b.bitwiseAND(mask))))
    rows = rows.withColumn("__found", F.when(k.isNotNull(), F.flatten(F.array_compact(same))))
    words = F.concat("__found", F.transform("__found", lambda x: x + 1), F.transform("__found", lambda x: x + 2))
    covered = F.when(k.isNotNull(), F.size(F.array_distinct(words))).when(m > mask, _covered_long(t)).otherwise(0)
    return rows.withColumn(out, covered.cast("bigint")).drop("__keys", "__found")


def _covered_long(threes: Column) -> Column:
    """The same for texts of more windows than a sort key can tell apart."""
    m = F.size(threes)
    tagged = F.sort_array(F.transform(threes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    found = F.flatten(F.zip_with(F.slice(tagged, F.lit(1), m - 1), F.slice(tagged, F.lit(2), m - 1), lambda x, y: F.when(x["v"] == y["v"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)).otherwise(F.array().cast("array<int>"))))
    return F.size(F.array_distinct(found))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    }


def ratios(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """bucket, ratio: log of trusted over raw probability, for each bucket that occurs."""
    good = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")).distinct()
    good = staged(good, "good").withColumn("__good", F.lit(1))  # by its size on disk Spark broadcasts it or not
    rows = df.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(good, F.col("__doc") == F.col("__id"), "left")
    hashes = rows.select("__good", word_hashes(words_of(F.col("__text"))).alias("h"))
    each = hashes.select("__good", F.explode(F.concat("h", pair_hashes(F.col("h")))).alias("gram")).select("__good", bucket(F.col("gram")).alias("bucket"))
    counts = staged(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__good").alias("trusted")), "grams")
    raw, trusted = (n or 0 for n in counts.agg(F.sum("raw"), F.sum("trusted")).first())
    prior = PRIOR * BUCKETS
    p_raw = F.col("raw") / F.lit(float(max(raw, 1)))
    p_trusted = (F.col("trusted") + prior * p_raw) / F.lit(trusted + prior)
    return counts.select("bucket", (F.lit(0.0) if not trusted else F.log(p_trusted / p_raw)).alias("ratio"))


def judge(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base columns, base_failed, ratio, kept of every row."""
    table = staged(ratios(df, labels, doc_id=doc_id, text=text, label=label), "ratios")
    slots = df.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(table, "bucket", "left")
    array = slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0.0)).alias("r")))), lambda s: s["r"]).alias("r")).scalar()  # BUCKETS numbers
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).withColumn("__w", words_of(F.col("__text")))
    rows = rows.select("doc_id", word_hashes(F.col("__w")).alias("__h"), *(c.alias(n) for n, c in base_columns(F.col("__text"), F.col("__w")).items()))
    rows = rows.withColumn("__p", pair_hashes(F.col("__h")))
    rows = rows.withColumn("__t", window_hashes(F.col("__h"), F.col("__p"))).withColumn("__table", array)
    add = lambda sum_, g: sum_ + F.get(F.col("__table"), bucket(g))
    total = F.aggregate("__p", F.aggregate("__h", F.lit(0.0), add), add)
    rows = repeat_words(rows.withColumn("ratio", F.when(F.size("__h") > 0, total / (F.size("__h") + F.size("__p"))).otherwise(0.0)), "__t", "n_repeat_words")
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= keep_from))
