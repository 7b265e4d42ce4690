"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight; within a source, documents go in the order of
their keys until the running sum of their sizes meets the source's budget. Budgets above a source's size take complete
epochs first and select only the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Slices of the key's range; a source's running sum is taken slice by slice, so that no task holds a whole source.
SLICES = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality(text: Column, size: Column) -> Column:
    """Share of lower-case word endings among words, held to 0.1 ... 1: junk and markup draw larger keys, so come later."""
    letters = F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}]{2,}[,.]?(?=[\x20\x09-\x0D]|$)")), F.lit(0))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), letters / F.greatest(size, F.lit(1))))


def targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """sizes: mix_source, source_size. Adds target. Water filling in closed form: with sources ordered by size / weight,
    a source is held at its cap if the level that the other sources would reach lies above it. One row per source, all in one
    task: meant for up to some ten million sources; documents never meet there."""
    order = W.orderBy(F.col("mix_source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last())
    everything = W.partitionBy()
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
        .withColumn("held", F.col("level") * F.col("w") > F.col("cap"))
    )
    # Once one source is not held, none after it is: the first such row's level is the final one.
    first = F.min(F.when(~F.col("held"), F.col("cap") / F.col("w"))).over(everything)
    ranked = ranked.withColumn("first", first).withColumn(
        "final", F.max(F.when(~F.col("held") & (F.col("cap") / F.col("w") == F.col("first")), F.col("level"))).over(everything)
    )
    return ranked.select(
        "mix_source", "source_size",
        F.when(F.col("held") & (F.col("cap") / F.col("w") < F.coalesce("first", F.lit(float("inf")))), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("final") * F.col("w"), F.col("cap").cast("double"))).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, quality_column: str | None = None) -> DataFrame:
    """One row per document: doc_id, mix_source, size, source_size, target, taken.

    Documents are taken whole in the order of -ln(u) / quality while the source's budget lasts; the one that crosses it
    gives only the words still missing, so a source's sum is its target rounded to a word. u comes from a hash of doc_id
    and seed: reruns agree, repeated ids share a key and go by size. Null or empty texts have size 0 and take 0; the null
    source is a source of its own, last in order; a null doc_id counts as an id. Texts of any length count whole; an empty
    table gives an empty result. Extra columns are not carried.
    """
    size = word_count(F.col("text"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    rows = docs.select(
        "doc_id", F.col("source").alias("mix_source"), size.alias("size"),
        (-F.log(u) / (F.col(quality_column).cast("double") if quality_column else quality(F.col("text"), size))).alias("key"),
    )
    # The key is spread by 1 - exp(-key / 4): slices of about the same number of documents, in the order of the keys.
    rows = rows.withColumn("slice", F.floor(F.lit(SLICES) * (1 - F.exp(-F.col("key") / 4))).cast("int"))
    rows = materialise(rows, "mix-rows")  # texts are read once: sizes and keys serve the sums and the order
    per_slice = rows.groupBy("mix_source", "slice").agg(F.sum("size").alias("slice_size"))
    offsets = per_slice.withColumn(
        "before", F.coalesce(F.sum("slice_size").over(W.partitionBy("mix_source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    goals = targets(per_slice.groupBy("mix_source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    head = offsets.select(F.col("mix_source").alias("s"), F.col("slice").alias("k"), "before").join(
        goals.select(F.col("mix_source").alias("t"), "source_size", "target"), F.col("s").eqNullSafe(F.col("t"))
    ).drop("t")
    inner = W.partitionBy("mix_source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(head, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("within")))
    return placed.select("doc_id", "mix_source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("mix_source")


OP6_SQL = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(len(regexp_extract_all(text, '[\p{L}][\p{L}]+[,.]?(?:[\x20\x09-\x0D]|$)')), 0) as letters from documents),
k as (select doc_id, source, size, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
             / greatest(0.1, least(1.0, letters / greatest(size, 1))) as key from d),
s as (select source, sum(size)::bigint as source_size,
             [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from k group by source),
-- each round holds the sources whose share is above three times their size, and shares out what is left
fill(round, held, level) as (
  select 0, []::varchar[], (select sum(source_size) / sum(w) from s)
  union all
  select round + 1,
         (select list(coalesce('s' || source, 'null') order by source) from s where level * w > 3 * source_size),
         (select (sum(source_size) - sum(case when level * w > 3 * source_size then 3 * source_size else 0 end))
                 / sum(case when level * w > 3 * source_size then 0 else w end) from s)
  from fill where round < 40 and (select count(*) from s where level * w > 3 * source_size) > len(held)),
l as (select level from fill order by round desc limit 1),
g as (select source, source_size, least(level * w, 3.0 * source_size)::double as target from s, l),
p as (select k.*, source_size, target, coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from k join g on k.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then (round(target)::bigint // source_size) * size else 0 end
        + greatest(0, least(size, round(target)::bigint - case when source_size > 0 then (round(target)::bigint // source_size) * source_size else 0 end - before)))::bigint as taken
from p
"""
