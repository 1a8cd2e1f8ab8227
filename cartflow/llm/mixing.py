"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources by code point, null last, weigh 5, 2, 1, 5, ... and share the total
size in that proportion; a source is repeated at most ``most`` times, and what
it can't give goes to the others by weight.  A source first gives as many
complete epochs as its target holds; for the rest its documents are drawn
without replacement: each gets the exponential key ``-ln(u) / quality`` with
``u`` from a hash of its id, and documents are taken in the order of keys up to
the budget.  The document that meets the budget's end gives its first words up to
it, so a source's words are its target, rounded down.

DataFrame functions only.  Only ids, sizes and keys are shuffled, never texts,
in a sort by (source, key) over as many partitions as needed, so a hot source
is no single group.

Null text has size 0, null id hashes to a constant; equal keys go by id, then
by a hash of the text.  Repeated rows are documents of their own.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartflow.llm.common import cut, own_names, ranged, running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """The share of letters among a text's characters, from 0.25 to 1: prose is likelier to be drawn than markup or numbers."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.25), letters / F.greatest(F.length(text), F.lit(1))).cast("double")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of seed and id (which any SQL engine can follow)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` -> with ``target``.

    Sources whose share would pass ``most`` times their size are those with
    the least size for their weight; leaving them out one after the other
    raises the share of the rest, until the next one fits.  One row per
    source, in windows over sources only.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_i", F.row_number().over(by_code) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({"_total": F.sum("source_size").over(everything), "_weights": F.sum("_w").over(everything),
                       "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
                       "_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    w = w.withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_gone")))
    # the level at the first source (by ratio) that isn't full holds for all after it
    w = w.withColumn("_free", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_cap") / F.col("_w"))).over(everything))
    w = w.withColumn("_held", F.min(F.when((F.col("_cap") / F.col("_w") == F.col("_free")), F.struct("_i", "_level"))).over(everything)["_level"])
    return w.select("source", "source_size",
                    F.when(F.col("_cap") / F.col("_w") < F.col("_free"), F.col("_cap")).otherwise(F.least(F.col("_held") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
        extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies (whole ones), part (words of one more), taken (all words), and the ``extra`` columns.

    ``weight``: quality weight of a document, above 0 (default: :func:`quality_weight`).
    """
    extra = extra or {}
    weight = quality_weight(F.col("text")) if weight is None else weight
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("_key"),
                       F.xxhash64("text").alias("_tie"), *[c.alias(n) for n, c in extra.items()])
    order = [F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    placed = ranged(slim, ["source"], order)
    wanted = cut(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    before = running(placed, ["source"], order, {"_before": F.col("size")})
    wanted = wanted.withColumnRenamed("source", "_source")
    rows = before.join(wanted, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size") + 1e-6)
    # words of one more copy: all of the document, or those up to the end of the budget
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    rows = rows.withColumns({"epochs": epochs.cast("long"), "more": more.cast("long")})
    return rows.select("doc_id", "source", "size", F.col("source_size"), "target",
                       (F.col("epochs") + (F.col("more") == F.col("size")).cast("long")).alias("copies"),
                       F.when(F.col("more") < F.col("size"), F.col("more")).otherwise(F.lit(0)).cast("long").alias("part"),
                       (F.col("size") * F.col("epochs") + F.col("more")).alias("taken"), *extra)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``; a part of a document comes as a copy with that text."""
    held = own_names(docs, "doc_id", "source", "text")
    # rows carry their own number, for ids may repeat; the numbered rows stay in the shared folder
    numbered = cut(held.withColumn("_row", F.monotonically_increasing_id()))
    times = mix(numbered, extra={"_row": F.col("_row")}, **options).where("taken > 0").select("_row", "copies", "part")
    rows = numbered.join(times, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("copies") + (F.col("part") > 0).cast("long")).cast("int"))))
    text = F.when(F.col("_copy") > F.col("copies"), first_words(F.col("text"), F.col("part"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*held.columns).toDF(*docs.columns)


def mixing_sql(seed: int = 7) -> str:
    """The mix of the documents table in DuckDB SQL."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u,
         greatest(0.25, length(regexp_replace(coalesce(text, ''), '[^\pL]+', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE)) AS w
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
             3.0 * source_size AS cap FROM s),
r AS (
  SELECT 0 AS step, source, w, cap, source_size, false AS full_, (SELECT sum(source_size) FROM o)::DOUBLE / (SELECT sum(w) FROM o) AS level FROM o
  UNION ALL
  SELECT step + 1, source, w, cap, source_size, f, CASE WHEN n = sum(f::INT) OVER () THEN level
         ELSE (total - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN f THEN 0 ELSE w END) OVER () END
  FROM (SELECT *, full_ OR level * w > cap AS f, count(*) OVER () AS n, sum(source_size) OVER () AS total FROM r)
  WHERE step < 60),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE least(level * w, cap) END AS target FROM r WHERE step = 60),
k AS (SELECT d.*, CAST(t.source_size AS BIGINT) AS ss, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / d.w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN ss > 0 THEN least(floor(target / ss), 3) ELSE 0 END AS epochs FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target,
       CAST(size * epochs + greatest(0, least(size, floor(target - epochs * ss + 1e-6) - before)) AS BIGINT) AS taken
FROM e"""
