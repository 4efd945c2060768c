"""The queries of this subpackage, each one operator with production parameters over a whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, fingerprints, html, licenses, mixing, packing, quality, rans, rules, simhash
from .common import table
from .tokens import vocabulary


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), path=vocabulary())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = rans.token_files(table(spark, sf_dir, "documents"), path=vocabulary())
    return rans.read_files(spark, folder, manifest)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    first = planned.withColumn("position", F.coalesce(F.get("positions", F.lit(0)), F.lit(mixing.POSITIONS)))
    return mixing.in_order(first.select("doc_id", "size", "source_size", "target", "taken", "position"), "position", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.transform("sentence_ids", lambda k: k.cast("string")), ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_best_fit_packing, op2_token_files, op3_quality_classifier, op4_substring_dedup, op5_quality_rules, op6_mixing, op7_simhash, op8_fingerprints, op9_license_scan, op10_html_extraction)
    return {f.__name__: f for f in every}


def mixing_sql() -> str:
    return r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
weighed AS (SELECT *, r % 3 + 1 AS w, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce((SELECT level FROM levels WHERE cap > level * w ORDER BY cap / w, source NULLS LAST LIMIT 1), 0.0::DOUBLE) AS level),
targets AS (SELECT source, source_size, w, least(cap::DOUBLE, chosen.level * w) AS target FROM levels, chosen),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.w,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 1 ELSE whole + CASE WHEN size > 0 AND before + size / 2 <= target - whole * source_size AND whole < 3 THEN 1 ELSE 0 END END AS copies,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, before::DOUBLE / target) ELSE 0.0 END AS share
  FROM placed)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN 1000000000 ELSE least(999999999, floor(1000000000 * CASE w
         WHEN 1 THEN (sqrt(1.5::DOUBLE * 1.5::DOUBLE + (-1.0::DOUBLE) * share * 2.0::DOUBLE) - 1.5::DOUBLE) / (-1.0::DOUBLE)
         WHEN 2 THEN share
         ELSE (sqrt(0.5::DOUBLE * 0.5::DOUBLE + 1.0::DOUBLE * share * 2.0::DOUBLE) - 0.5::DOUBLE) / 1.0::DOUBLE END)::BIGINT) END::BIGINT AS position
FROM counted"""


def license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "[" + ", ".join(map(quote, licenses.KNOWN)) + "]"
    ids = "[" + ", ".join(map(str, licenses.KNOWN.values())) + "]"
    names = list(dict.fromkeys(n for n, _ in licenses.RULES))
    like = {n: "(" + " OR ".join("line LIKE '%" + "%".join(f"|{k}|" for k in rule) + "%'" for m, rule in licenses.RULES if m == n) + ")" for n in names}
    for name, less in licenses.COVERED.items():
        for n in less:
            like[n] += f" AND NOT {like[name]}"
    hits = ", ".join(f"CASE WHEN {like[n]} THEN '{n}' END" for n in names)
    found = lambda t: rf"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)), lambda s: coalesce(list_position({known}, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), 0)), lambda k: k > 0)"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
candidates AS (SELECT doc_id, t, {found('t')} AS a, {found("regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g')")} AS b FROM texts WHERE regexp_matches(lower(t), '{licenses.TRIGGER}')),
ids AS (SELECT doc_id, list_transform(CASE WHEN len(b) > len(a) THEN b ELSE a END, lambda k: {ids}[k]) AS k FROM candidates
        UNION ALL SELECT doc_id, []::INT[] FROM texts WHERE NOT regexp_matches(lower(t), '{licenses.TRIGGER}')),
lines AS (SELECT doc_id, k, '|' || coalesce(array_to_string(list_transform(k, lambda x: x::VARCHAR || '|'), '|'), '') AS line FROM ids)
SELECT doc_id, coalesce(array_to_string(k, ','), '') AS sentence_ids, coalesce(array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ','), '') AS licenses FROM lines"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing_sql(), "op9_license_scan": license_sql()}
