"""URL filters: rules by host and path, and lists of canonical URLs.

A list is held as a blocked Bloom filter: a key sets and tests bits of one
512-bit block only. URLs that the filter lets through are not on the list; the
possible hits go to an exact join with it, which removes false positives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # of 64 bits in a block
BITS_PER_KEY = 16
BITS_SET = 8
#: A filter of up to so many blocks (64 bytes each) is broadcast; a larger one is joined by block.
BROADCAST_BLOCKS = 500_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """``rule("block", "example.net/de/8")``"""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """The form in which URLs are listed and looked up; null if there is no host.

    Host without ``www.`` and without the ports 80 and 443, path without
    ``.html`` and slashes at its end, and the query's fields in order, without
    empty ones and those named ``utm_...``; no scheme and no fragment.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(\.html)?/*$", "")
    at = F.instr(url, "://")
    query = F.regexp_extract(F.substr(url, at + 3), r"^[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits that a key sets in its block, as ``WORDS`` longs: nine-bit slices of two hashes choose them."""
    one, two = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    bits = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(511).cast("int") for h in (one, two) for i in range(BITS_SET // 2)]
    none = F.lit(0).cast("long")
    power = [F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63)) for b in bits]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.shiftright(b, 6) == w, p).otherwise(none) for b, p in zip(bits, power)]) for w in range(WORDS)]


def build_filter(listed: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """A row (block, w0 to w7) for each block that holds a key, and the number of blocks."""
    blocks = max(1, math.ceil(n_keys * BITS_PER_KEY / (64 * WORDS)))
    masks = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def probe(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is not on the list."""
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    else:  # keys are dealt by block: rows without one would all be dealt to one task
        rows, none = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col(key)))])
    joined = rows.withColumn("block", _block(F.col(key), blocks)).join(bloom, "block", "left")
    probed = joined.withColumn("_maybe", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])
    return probed if blocks <= BROADCAST_BLOCKS else probed.unionByName(none.withColumn("_maybe", F.lit(False)))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", list_col: str = "url"
) -> DataFrame:
    """Columns ``id_col``, url, host, path, canonical_url, rule, verdict, listed.

    The longest rule that fits decides; where none does, a URL whose canonical
    form is on the list ``listed`` (raw URLs, repeats and nulls allowed) is
    blocked and others are allowed. ``listed`` in the result is null where a
    rule decided. Null URLs and those without ``://`` have empty host and path
    and are allowed. Repeated rows stay repeated; an empty list blocks nothing.
    """
    url = F.col("url")
    rows = (
        pages.select(F.col(id_col), F.col(url_col).alias("url"))
        .select(id_col, "url", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), canonical(url).alias("canonical_url"))
        .withColumn("_found", matched_rule(F.col("host"), F.col("path"), rules))
    )
    keys = listed.select(canonical(F.col(list_col)).alias("_key")).where("_key is not null").distinct()
    keys = materialise(keys, "listed-urls")
    bloom, blocks = build_filter(keys, "_key", keys.count())
    undecided = F.when(F.col("_found").isNull(), F.col("canonical_url"))
    probed = probe(rows.withColumn("_key", undecided), "_key", bloom, blocks)
    clear = probed.where(~F.col("_maybe")).withColumn("_listed", F.when(F.col("_found").isNull(), F.lit(False)))
    suspects = probed.where("_maybe").join(keys.withColumn("_on", F.lit(True)), "_key", "left").withColumn("_listed", F.coalesce("_on", F.lit(False)))
    out = clear.unionByName(suspects.drop("_on"))
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    return out.select(id_col, "url", "host", "path", "canonical_url", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), F.col("_listed").alias("listed"))
