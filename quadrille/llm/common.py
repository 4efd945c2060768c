"""What the operators of this subpackage share: words, names that cannot clash, and the library's staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import new_path, shared_dir, staged

__all__ = ["SPACES", "new_path", "hash_sample", "own", "parts_for", "shared_dir", "small_batches", "staged", "table", "words_of"]

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def own(*names: str) -> list[str]:
    """Names for helper columns that no table of a user has."""
    return [f"__quadrille_{n}" for n in names]


#: Rows of an Arrow batch at most. Rows are whole texts here, and a batch is held by the JVM and by the Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have BATCH_ROWS rows at most; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(ids: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` rows of ids, those with the smallest hash of `column`. Rows that can't be among them are left out before the sort, so that one task sees about twice `most` rows, however many there are."""
    rows = ids.count()
    key = F.pmod(F.xxhash64(column), F.lit(1 << 32))
    return ids.where(key < int((1 << 32) * min(1.0, 2 * most / max(1, rows)) + 1)).orderBy(key, column).limit(most)


def parts_for(spark: SparkSession, amount: int, least: int, most: int) -> int:
    """Partitions of a sorted rewrite: `most` of the amount each where there is much, fewer where the cores would idle, but no less than `least` each."""
    return max(1, -(-amount // most), min(-(-amount // least), 12 * spark.sparkContext.defaultParallelism))
