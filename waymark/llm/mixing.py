"""Mixing of sources to target weights by temperature.  DataFrame functions only.

A source's weight is its share of the tokens, raised to an exponent and
normalised.  The exponent is bisected until the mixture has a target entropy,
and moved towards 1 until no source is repeated more often than a limit.  The
weights are then realised under a budget of tokens: each source runs through
whole epochs of its documents and part of one more.  An epoch is a permutation
of the source's blocks (documents dealt out by a hash of doc_id and text) and of
each block's documents; the partial epoch ends where the budget does.

Running sums are taken over blocks and within a block, and a block's size does
not depend on its source's, so the documents of a source that holds most rows
are no single task's load; its blocks, one row for a million tokens, are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Columns, small_or_plain, written

BLOCK_TOKENS = 1_000_000
#: Exponents tried in one pass over the sources; a pass narrows the bracket by this many and one.
TRIED = 15


def words(text: Column) -> Column:
    """Number of runs of characters outside 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisected(holds, low: float, high: float, rounds: int = 60) -> float:
    """The smallest exponent for which holds() is true, if it is true from there on; high if it never is.

    holds takes a list of exponents and tells for each.
    """
    if holds([low])[0]:
        return low
    for _ in range(rounds):
        if high - low <= 1e-15:
            break
        step = (high - low) / (TRIED + 1)
        tried = [low + step * k for k in range(1, TRIED + 1)]
        found = [a for a, yes in zip(tried, holds(tried), strict=True) if yes]
        failed = [a for a in tried if not found or a < found[0]]
        if found:
            high = found[0]
        if failed:
            low = failed[-1]
    return high


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The exponent for sources(tokens).

    It is the largest whose mixture has at least the target entropy (in nats), or
    0 without one; if that repeats a source more than max_repeats times, the
    nearest one on the way to 1 that doesn't, and the entropy is missed.  1
    without either.

    Without a budget, repeats are those of the mixture that runs once through the
    source that is repeated least.
    """
    some = sources.where("tokens > 0")
    total, least, most, n = some.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or (target_entropy is None and max_repeats is None):
        return 1.0
    p = F.col("tokens") / float(total)

    def sums(tried: list[float]) -> list[tuple[float, float]]:
        row = some.agg(*(f(F.pow(p, F.lit(a)) * x) for a in tried for f, x in ((F.sum, F.lit(1.0)), (F.sum, F.log(p))))).first()
        return [(row[2 * k], row[2 * k + 1]) for k in range(len(tried))]

    a = 0.0
    if target_entropy is not None:
        if target_entropy > math.log(n) + 1e-12:
            raise ValueError("no mixture of these sources has that entropy")
        a = bisected(lambda tried: [math.log(s) - x * y / s < target_entropy for x, (s, y) in zip(tried, sums(tried), strict=True)], 0.0, 8.0)
    if max_repeats is None:
        return a
    if max_repeats < 1 or (budget is not None and budget > max_repeats * total * (1 + 1e-9)):
        raise ValueError("max_repeats must be 1 at least, and the budget no more than that many times all tokens")

    def repeats(tried: list[float]) -> list[float]:
        """Of the source that is repeated most."""
        if budget is None:
            return [(most / least) ** abs(1 - x) for x in tried]
        return [budget / total * max((z / total) ** (x - 1) for z in (least, most)) / s for x, (s, _) in zip(tried, sums(tried), strict=True)]

    # the further from 1, the more often the most repeated source is repeated
    sign = 1 if a <= 1 else -1
    return 1 - sign * (1 - bisected(lambda tried: [r <= max_repeats for r in repeats([1 - sign * (1 - x) for x in tried])], 1 - abs(1 - a), 1.0))


def digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)).cast("binary"))


def key_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def hash_of(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 4, budget: float | None = None, seed: str = "0", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, position) of every use of a row of docs(doc_id, text, source, ...).

    Tokens are runs of characters outside 0x20 and 0x09-0x0D.  epoch counts a
    source's runs through its documents from 0; position: its tokens before the
    document in that epoch.  budget: tokens of the whole mixture; None: as many as
    run once through the source that is repeated least, so that every document
    is used.  No source exceeds its part of the budget.

    A null source is a source of its own.  Null text: 0 tokens; a source without
    tokens has no weight and runs once.  Rows that repeat a doc_id are documents
    of their own, dealt out by their texts; null doc_ids likewise.  An empty table
    gives no rows.
    """
    return _placed(docs, target_entropy, max_repeats, budget, seed, block_tokens).select("doc_id", "source", "n_tokens", "epoch", "position")


def _placed(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 4, budget: float | None = None, seed: str = "0", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """mixture() with key and hash, which tell rows of one doc_id apart."""
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), key_of(F.col("source")).alias("key"), words(F.col("text")).alias("n_tokens"), hash_of(F.col("text")).alias("hash")), "sizes")
    sources = written(sized.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "sources")
    a = exponent(sources, target_entropy, max_repeats, budget)
    some = sources.where("tokens > 0")
    total, most, n_sources = some.agg(F.coalesce(F.sum("tokens"), F.lit(1)), F.coalesce(F.max("tokens"), F.lit(1)), F.count("*")).first()
    n_sources += 1
    if budget is None and a <= 1:
        runs = F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - a))
    else:
        p = F.col("tokens") / float(total)
        s = some.agg(F.coalesce(F.sum(F.pow(p, F.lit(a))), F.lit(1.0))).first()[0]
        least = some.agg(F.coalesce(F.min(F.pow(p, F.lit(a - 1)) / s), F.lit(1.0))).first()[0]
        scale = 1 / least if budget is None else budget / total
        runs = F.lit(scale / s) * F.pow(p, F.lit(a - 1))
    planned = sources.withColumn("runs", F.when(F.col("tokens") > 0, runs).otherwise(1.0))
    planned = planned.withColumn("whole", F.floor(F.col("runs") + 1e-9).cast("int"))
    planned = planned.withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("runs") - F.col("whole")) * F.col("tokens") + 1e-6).cast("long"))
    planned = planned.withColumn("blocks", (1 + F.floor(F.col("tokens") / block_tokens)).cast("long"))
    planned = small_or_plain(planned, n_sources)

    one = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "hash")
    place = F.conv(F.substring(digest(seed, one), 1, 12), 16, 10).cast("long")
    dealt = sized.join(planned.select("key", "blocks"), "key").withColumn("block", F.pmod(place, "blocks"))
    blocks = dealt.groupBy("key", "block").agg(F.sum("n_tokens").alias("size"))
    last = F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)
    each = blocks.join(planned.select("key", "whole", "rest", last.alias("last")), "key").where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    each = each.withColumn("order", digest(seed, F.col("epoch"), F.col("key"), F.col("block")))
    before = Window.partitionBy("key", "epoch").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    each = each.where((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("rest"))).select("key", "block", "epoch", "start", F.when(F.col("epoch") == F.col("whole"), F.col("rest")).alias("upto"))
    used = dealt.select("doc_id", "source", "n_tokens", "hash", "key", "block").join(each, ["key", "block"])
    used = used.withColumn("order", digest(seed, F.col("epoch"), one))
    within = Window.partitionBy("key", "epoch", "block").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("position", F.col("start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    used = used.where(F.col("upto").isNull() | (F.col("position") + F.col("n_tokens") <= F.col("upto")))
    return used


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mixture uses them; same columns, whatever their names.  See mixture().

    Rows that agree in doc_id, source and text are each used as often as the one
    used most.
    """
    own = Columns(docs)
    used = _placed(docs, **how).select(F.col("doc_id").alias("id"), F.xxhash64("key", "hash").alias("tag"), "epoch").distinct()
    used = written(used.groupBy("id", "tag").agg(F.count("*").cast("int").alias("uses")).where("uses > 0"), "uses")
    rows = own.df.withColumn("own_tag", F.xxhash64(key_of(F.col(own["source"])), hash_of(F.col(own["text"]))))
    joined = rows.join(small_or_plain(used, used.count()), F.col(own["doc_id"]).eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag")))
    return own.back(joined.withColumn("uses", F.explode(F.sequence(F.lit(1), F.col("uses")))))


#: DuckDB SQL with the rows of mixture() of documents with max_repeats = 4 and no budget.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, COALESCE('=' || source, '') AS key,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
         COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || md5(COALESCE(text, '')) AS one
  FROM documents),
sources AS (SELECT key, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY key),
ends AS (SELECT CAST(max(tokens) AS DOUBLE) AS most, CAST(min(tokens) AS DOUBLE) AS least FROM sources WHERE tokens > 0),
halved(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN (SELECT most / least FROM ends) <= 4 THEN 0.0 ELSE 1.0 END::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN pow((SELECT most / least FROM ends), 1 - (low + high) / 2) <= 4 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow((SELECT most / least FROM ends), 1 - (low + high) / 2) <= 4 THEN (low + high) / 2 ELSE high END
  FROM halved WHERE k < 60),
found AS (SELECT high AS a FROM halved WHERE k = 60),
runs AS (SELECT key, tokens, CASE WHEN tokens > 0 THEN pow((SELECT most FROM ends) / tokens, 1 - (SELECT a FROM found)) ELSE 1.0 END AS runs FROM sources),
planned AS (
  SELECT key, CAST(floor(runs + 1e-9) AS INTEGER) AS whole,
         CAST(floor(greatest(0.0, runs - floor(runs + 1e-9)) * tokens + 1e-6) AS BIGINT) AS rest,
         CAST(1 + floor(tokens / 1000000.0) AS BIGINT) AS blocks
  FROM runs),
dealt AS (
  SELECT s.*, ('0x' || substr(md5('0|' || one), 1, 12))::BIGINT % blocks AS block
  FROM sized s JOIN planned USING (key)),
sums AS (SELECT key, block, sum(n_tokens) AS size FROM dealt GROUP BY key, block),
each AS (
  SELECT key, block, size, whole, rest, CAST(e AS INTEGER) AS epoch, md5('0|' || e || '|' || key || '|' || block) AS ord
  FROM sums JOIN planned USING (key), LATERAL (SELECT unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS e)),
placed AS (
  SELECT *, COALESCE(sum(size) OVER (PARTITION BY key, epoch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM each),
used AS (
  SELECT d.doc_id, d.source, d.n_tokens, p.epoch, p.whole, p.rest,
         p.start + COALESCE(sum(d.n_tokens) OVER (PARTITION BY d.key, p.epoch, d.block
           ORDER BY md5('0|' || p.epoch || '|' || d.one), d.doc_id, d.n_tokens
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM dealt d JOIN placed p ON d.key = p.key AND d.block = p.block
  WHERE p.epoch < p.whole OR p.start < p.rest)
SELECT doc_id, source, n_tokens, epoch, CAST(position AS BIGINT) AS position
FROM used WHERE epoch < whole OR position + n_tokens <= rest
"""
