"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the corpus over its
share now. A document's count is the Poisson quantile of a number that its id
and the seed decide; the document is repeated so often and all copies are
shuffled globally by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import materialise, quoted, uniform

#: Exponent of the sources' sizes in the target shares, where no weights are given: 1 leaves them, 0 evens them.
TEMPERATURE = 0.7


def poisson_table(rate: Column) -> Column:
    """Array of P(X <= k) for k from 0 until what is left is below what 52 bits can tell."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        log_p = a["log_p"] + F.log(rate / k)
        total = a["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(a["all"], total).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["all"])).otherwise(F.array(F.lit(1.0)))


def _named(source: Column) -> Column:
    """A source as a key: null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", text_col: str = "text", scale: float = 1.0) -> DataFrame:
    """A row (source, bytes, rate, table) for each source.

    ``weights`` gives target shares by source (sources not named get 0, shares
    need not add up to 1); without it the shares follow the sources' bytes to
    the power TEMPERATURE. ``scale`` is the size of the mixed corpus over that
    of the given one.
    """
    size = F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long")
    stats = docs.groupBy(quoted(source_col).alias("source")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        share = F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            if not (w >= 0 and math.isfinite(w)):
                raise ValueError(f"weight of {name}: {w}")
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(share)
    shares = materialise(stats.withColumn("share", share), "source-shares")  # a row for each source
    total = shares.agg(F.sum("bytes"), F.sum("share")).first()
    all_bytes, all_share = float(total[0] or 0), float(total[1] or 0)
    rate = F.when((F.col("bytes") > 0) & F.lit(all_share > 0), scale * F.col("share") / (all_share or 1.0) * all_bytes / F.col("bytes")).otherwise(0.0)
    return shares.select("source", "bytes", rate.alias("rate")).withColumn("table", poisson_table(F.col("rate")))


def replicate(
    docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, scale: float = 1.0
) -> DataFrame:
    """All columns of ``docs`` with _copy (from 0), _rate and _shuffle_key, globally shuffled.

    Documents with count 0 are left out: that is the sampling asked for. A
    null source is a source of its own; null and empty texts weigh nothing, a
    source of weight 0 or without bytes gives no rows, and an empty table gives
    an empty one. Rows that repeat an id (null too) repeat its count. The
    shuffle key is a hash of (id, copy, seed); with the text's size, which parts
    rows of one id, it decides the partition of a copy, and its place there.
    Columns of those three names in ``docs`` are replaced; others keep their values, whatever their names.
    """
    keep = [c for c in docs.columns if c.lower() not in ("_copy", "_rate", "_shuffle_key")]
    rates = source_rates(docs, weights, source_col, text_col, scale).select(_named(F.col("source")).alias("name"), "rate", "table")
    rates = materialise(rates, "source-rates")  # its size is known then: Spark broadcasts it only if it is small
    key, size = quoted(id_col), F.coalesce(F.octet_length(quoted(text_col)), F.lit(-1))
    rows = docs.select(F.struct(*[quoted(c) for c in keep]).alias("row"), key.alias("id"), size.alias("size"), _named(quoted(source_col)).alias("name"), uniform(key, seed, "count").alias("u"))
    count = F.size(F.filter("table", lambda c: c < F.col("u")))
    copies = rows.join(rates, "name").withColumn("n", count).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    order = F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("~")), F.col("copy"), F.lit(seed), F.lit("order"))), 1, 16)
    shuffled = copies.select("row", "size", "copy", "rate", order.alias("order")).repartition("order", "size").sortWithinPartitions("order", "copy")
    return shuffled.select(*[F.col("row")[c].alias(c) for c in keep], F.col("copy").alias("_copy"), F.col("rate").alias("_rate"), F.col("order").alias("_shuffle_key"))
