"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document's size is its number of words (runs of characters other than ASCII white
space).  Sources, in code-point order with null last, get weights in turn and share
``share`` times all words; no target exceeds ``limit`` times its source's size, and what
is over is shared again by weight.  Within a source every document expects
target / source size copies.  The expected copies are summed along the documents in
order of size, one random offset is added, and a document is emitted once per integer
boundary that its interval crosses.  Going by size keeps the words taken within about one
long document of the target.

Defined cases: a null text has size 0 and takes no words; null sources form a source of
their own; null ids sort first; rows that are alike are documents of their own; an empty
table gives an empty table; other columns pass through, whatever their names.

No task holds a whole source: positions come from counts by (source, size, bucket) and a
row number within that triple, so a source with a third of all rows is spread out.  Buckets
go by a hash of id and text, and there is one for every BUCKET_ROWS documents.  Only the
targets are made in one place, from one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, prefixed, table

WORD = r"[^\x20\x09-\x0D]+"
#: Least number of buckets, and rows for each.
BUCKETS, BUCKET_ROWS = 16, 50_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Water filling over one row per source: (mx_source, mx_total, mx_target).

    With sources in order of cap / weight, those before a cut are at their caps and the
    others lie at one common level times their weight; the cut is the first at which the
    level does not exceed the cap.
    """
    by_name = Window.orderBy(F.col("mx_source").asc_nulls_last())
    by_cap = Window.orderBy("mx_ratio", F.col("mx_source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("mx_source").agg(F.sum("mx_size").alias("mx_total"))
    s = s.withColumn("mx_weight", weight).withColumn("mx_cap", F.col("mx_total") * F.lit(float(limit)))
    s = s.withColumn("mx_ratio", F.col("mx_cap") / F.col("mx_weight"))
    budget = F.sum("mx_total").over(everything) * F.lit(float(share))
    capped = F.coalesce(F.sum("mx_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("mx_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("mx_level", (budget - capped) / open_weight)
    fits = F.when(F.col("mx_level") <= F.col("mx_ratio"), F.struct("mx_ratio", "mx_level"))
    s = s.withColumn("mx_fit", F.min(fits).over(everything))
    target = F.coalesce(F.least(F.col("mx_cap"), F.col("mx_weight") * F.col("mx_fit.mx_level")), F.col("mx_cap"))
    return s.select("mx_source", "mx_total", target.alias("mx_target"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 17, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or ``keep``), and mx_size, mx_total, mx_target, mx_copies.

    A document with 0 copies stays as a row, so that callers see every decision.
    """
    kept = list(keep if keep is not None else docs.columns)
    text = F.coalesce(docs["`text`"], F.lit(""))
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    seen = F.md5(F.concat(F.coalesce(docs["`doc_id`"].cast("long").cast("string"), F.lit("")), F.lit("|"), text))
    whole = [docs[f"`{f.name}`"] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    d = docs.select(
        F.struct(*[c.alias(f"c{i}") for i, c in enumerate(prefixed(docs, kept))]).alias("mx_row"),
        docs["`source`"].alias("mx_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("mx_size"),
        docs["`doc_id`"].cast("long").alias("mx_id"),
        F.xxhash64(*whole).alias("mx_tie"),
        (F.conv(F.substring(seen, 1, 8), 16, 10).cast("long") % buckets).alias("mx_bucket"),
    )
    key = ["mx_source", "mx_size", "mx_bucket"]
    counts = d.groupBy(*key).agg(F.count(F.lit(1)).alias("mx_n"))
    targets = source_targets(counts.select("mx_source", (F.col("mx_size") * F.col("mx_n")).alias("mx_size")), weights, share, limit)
    before = Window.partitionBy("mx_source").orderBy("mx_size", "mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("mx_before", F.coalesce(F.sum("mx_n").over(before), F.lit(0))).drop("mx_n")
    base = base.alias("b").join(targets.alias("t"), F.col("b.mx_source").eqNullSafe(F.col("t.mx_source"))).select("b.*", "mx_total", "mx_target")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("mx_id").asc_nulls_first(), "mx_tie"))
    ranked = d.withColumn("mx_rank", rank)
    on = F.col("d.mx_source").eqNullSafe(F.col("b.mx_source")) & (F.col("d.mx_size") == F.col("b.mx_size")) & (F.col("d.mx_bucket") == F.col("b.mx_bucket"))
    out = ranked.alias("d").join(base.alias("b"), on).select("d.*", "mx_total", "mx_target", (F.col("mx_before") + F.col("mx_rank")).cast("double").alias("mx_at"))
    rate = F.when(F.col("mx_total") > 0, F.col("mx_target") / F.col("mx_total")).otherwise(F.lit(0.0))
    name = F.coalesce(F.concat(F.lit("="), F.col("mx_source")), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}"), name)), 1, 8)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = F.floor(F.col("mx_at") * rate + offset) - F.floor((F.col("mx_at") - 1.0) * rate + offset)
    copies = F.least(crossed, F.floor(F.lit(float(limit)))).cast("int")
    names = [F.col("mx_row")[f"c{i}"].alias(c) for i, c in enumerate(kept)]
    return out.select(*names, "mx_size", "mx_total", "mx_target", copies.alias("mx_copies"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix_sources(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return m.select(
        "doc_id",
        F.col("mx_size").alias("size"),
        F.col("mx_total").alias("source_size"),
        F.col("mx_target").alias("target"),
        (F.col("mx_copies") * F.col("mx_size")).cast("long").alias("taken"),
    )


def mix_stage(docs: DataFrame) -> DataFrame:
    """Rows of docs, each as often as the mix takes it."""
    m = mix_sources(docs, keep=DOCUMENT_COLUMNS)
    return m.where("mx_copies > 0").select(*DOCUMENT_COLUMNS, F.explode(F.sequence(F.lit(1), F.col("mx_copies"))).alias("mx_copy")).drop("mx_copy")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) % (SELECT greatest(16, (count(*) + 49999) // 50000) FROM documents) AS bucket
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
w AS (SELECT source, total, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight,
             total * 2.0::DOUBLE AS cap, (SELECT sum(total) FROM s) * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, cap / weight AS ratio,
             (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, total, coalesce(least(cap, weight * (SELECT level FROM f)), cap) AS target,
             CAST(('0x' || substr(md5('17' || coalesce('=' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.total, t.target, t.u, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0 END AS rate,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.bucket, d.doc_id ASC NULLS FIRST) AS DOUBLE) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
       CAST(least(floor(pos * rate + u) - floor((pos - 1.0) * rate + u), 2) AS BIGINT) * size AS taken
FROM r
"""
