"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are dealt to shards by a seeded hash and packed, in that order, into blocks of equal token counts within their
source and shard (a document counts where it begins). Blocks are allotted to the sources by highest quotients
weight / (2 s + 1), each source's blocks to its shards in the same way, and each shard takes so many of its blocks in
seeded order. How many blocks there are to allot is said by ``tokens``: a budget, of which a source that is too scarce
gives all its blocks and the others the rest (WHOLE: every block of every source of some weight); or None, the most
blocks that hold the target weights without using any twice, which the source scarcest against its weight decides.
``shares`` reports what of each source is taken, and how far that lies from its weight.

Defined results: a null source is a source of its own, written ''. A row without doc_id is placed by its text. A null or empty text has no tokens and goes with the
block that it falls into. Ties between quotients go to the source (shard) that sorts first. Repeated rows are rows of
their own. A source of weight 0 gets nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heappop, heapreplace
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

SEED, BLOCK_TOKENS, SHARD_TOKENS = 17, 8192, 1 << 23
WEIGHTS, OTHER_WEIGHT = {"src0": 10}, 1
WHOLE = 1 << 62  # a token budget that no corpus reaches


def apportion(weights: list, room: list[int], seats: int) -> list[int]:
    """Sainte-Lague: ``seats`` to parties of these weights, none above its room; ties to the earlier party."""
    seats = min(seats, sum(r for w, r in zip(weights, room) if w > 0))
    if seats <= 0:
        return [0] * len(weights)
    ws = [Fraction(w) for w in weights]
    size, room_left = np.array([float(w) for w in ws]), np.array(room, np.int64)

    def at(d: float) -> np.ndarray:
        """Seats whose quotients reach d; exact, as the few that lie close to d are counted in fractions."""
        exact = (size / d + 1) / 2
        got = np.floor(exact)
        for i in np.flatnonzero((np.abs(exact - np.rint(exact)) <= 1e-9 * np.maximum(exact, 1)) & (size > 0)):
            got[i] = floor((ws[i] / Fraction(d) + 1) / 2)
        return np.where(size > 0, np.minimum(np.maximum(got, 0), room_left), 0).astype(np.int64)

    low, high = 0.0, 2 * float(max(ws)) + 1  # at(high) gives no seat; at(low) would give all
    while at(mid := (low + high) / 2).sum() < seats:  # find some divisor that gives enough
        high = mid
    low = mid
    while high - low > 1e-6 * high and at(high).sum() < seats - 64:
        mid = (low + high) / 2
        if at(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    got = at(high).tolist()
    nexts = [(-w / (2 * g + 1), i) for i, (w, g, r) in enumerate(zip(ws, got, room)) if w > 0 and g < r]
    heapify(nexts)
    for _ in range(seats - sum(got)):  # the few that the divisor leaves
        i = nexts[0][1]
        got[i] += 1
        if got[i] < room[i]:
            heapreplace(nexts, (-ws[i] / (2 * got[i] + 1), i))
        else:
            heappop(nexts)
    return got


def _sized(rows: DataFrame, prefix: str, seed: int) -> DataFrame:
    text, doc = F.coalesce(F.col(f"{prefix}text").cast("string"), F.lit("")), F.col(f"{prefix}doc_id").cast("string")
    doc = F.coalesce(doc, F.md5(text.cast("binary")))  # rows without an id are spread over the shards too
    return rows.select(
        *rows.columns,
        F.coalesce(F.col(f"{prefix}source").cast("string"), F.lit("")).alias("_source"),
        F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long").alias("_tokens"),
        F.md5(F.concat(F.lit(f"{seed}:"), doc).cast("binary")).alias("_order"),
    )


def _blocks(sized: DataFrame, total: int, block_tokens: int, shard_tokens: int) -> DataFrame:
    shards = max(1, -(-total // shard_tokens))
    shard = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % F.lit(shards)
    before = Window.partitionBy("_source", "_shard").orderBy("_order", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_shard", shard)
    return placed.withColumn("_block", F.floor((F.sum("_tokens").over(before) - F.col("_tokens")) / F.lit(block_tokens)).cast("long"))


def allotted(available: DataFrame, weights: dict, other, seats: int | None) -> list[tuple]:
    """(source, weight, blocks, blocks taken) from (source, shard, blocks). One row a source comes to the driver."""
    totals = sorted((r["_source"], r["n"]) for r in available.groupBy("_source").agg(F.sum("_n").alias("n")).collect())
    ws = [weights.get(s, other) for s, _ in totals]
    if seats is None:
        whole = sum(Fraction(w) for w in ws)
        seats = min((floor(n * whole / Fraction(w)) for (_, n), w in zip(totals, ws) if w > 0), default=0)
    return [(s, w, n, got) for (s, n), w, got in zip(totals, ws, apportion(ws, [n for _, n in totals], seats))]


def quotas(available: DataFrame, weights: dict, other, seats: int | None = None) -> DataFrame:
    """(source, shard, quota) from (source, shard, blocks)."""
    got = {s: taken for s, _, _, taken in allotted(available, weights, other, seats)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard")
        n = [int(x) for x in pdf["_n"]]
        pdf["_quota"] = apportion(n, n, got[pdf["_source"].iloc[0]])
        return pdf[["_source", "_shard", "_quota"]]

    return available.groupBy("_source").applyInPandas(one, "_source string, _shard long, _quota long")


def _seats(tokens: int | None, block_tokens: int) -> int | None:
    return None if tokens is None else -(-tokens // block_tokens)


def _counted(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("_source", "_shard").agg(F.count("*").alias("_n"))


def _chosen(blocks: DataFrame, weights: dict, other, seed: int, seats: int | None) -> DataFrame:
    q = quotas(_counted(blocks), weights, other, seats)
    nth = Window.partitionBy("_source", "_shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "_source", "_shard", "_block").cast("binary")))
    ranked = blocks.withColumn("_nth", F.row_number().over(nth))
    return ranked.join(q, ["_source", "_shard"]).where("_nth <= _quota").select("_source", "_shard", "_block")


def mix(docs: DataFrame, weights: dict | None = None, other=OTHER_WEIGHT, block_tokens=BLOCK_TOKENS, shard_tokens=SHARD_TOKENS, seed=SEED, tokens: int | None = None) -> DataFrame:
    """The rows of docs that the mixture takes, with all their columns. Sizes move, no row does."""
    rows = C.placed(docs, "mix-docs")
    light = C.materialise(_sized(rows, "row.", seed).select("at", "_source", "_tokens", "_order"), "mix-sizes")
    blocks, chosen = _blocks_chosen(light, WEIGHTS if weights is None else weights, other, block_tokens, shard_tokens, seed, tokens)
    return C.without(rows, blocks.join(chosen, ["_source", "_shard", "_block"], "left_anti").select("at"), "mix-gone")


def _blocks_chosen(light: DataFrame, weights: dict, other, block_tokens: int, shard_tokens: int, seed: int, tokens: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``light`` with their blocks, and the blocks that the mixture takes."""
    total = light.agg(F.sum("_tokens")).first()[0] or 0
    placed = C.materialise(_blocks(light, total, block_tokens, shard_tokens), "mix-placed")
    return placed, _chosen(placed.select("_source", "_shard", "_block").distinct(), weights, other, seed, _seats(tokens, block_tokens))


def plan(docs: DataFrame, weights: dict | None = None, other=OTHER_WEIGHT, block_tokens=BLOCK_TOKENS, shard_tokens=SHARD_TOKENS, seed=SEED, tokens: int | None = None) -> DataFrame:
    """(doc_id, source, shard, block, tokens) of each row that the mixture takes."""
    rows = docs.select(F.struct("doc_id", "source", "text").alias("row"))
    sized = _sized(rows, "row.", seed).select(F.col("row.doc_id").alias("doc_id"), "_source", "_tokens", "_order")
    light = C.materialise(sized, "mix-sizes")
    placed, chosen = _blocks_chosen(light, WEIGHTS if weights is None else weights, other, block_tokens, shard_tokens, seed, tokens)
    return placed.join(chosen, ["_source", "_shard", "_block"], "left_semi").select("doc_id", F.col("_source").alias("source"), F.col("_shard").alias("shard"), F.col("_block").alias("block"), F.col("_tokens").alias("tokens"))


def shares(docs: DataFrame, weights: dict | None = None, other=OTHER_WEIGHT, block_tokens=BLOCK_TOKENS, shard_tokens=SHARD_TOKENS, seed=SEED, tokens: int | None = None) -> DataFrame:
    """(source, blocks, taken, kept_share, deviation): deviation is the share in the mixture less the target share."""
    rows = docs.select(F.struct("doc_id", "source", "text").alias("row"))
    light = C.materialise(_sized(rows, "row.", seed).select("_source", "_tokens", "_order"), "mix-sizes")
    total = light.agg(F.sum("_tokens")).first()[0] or 0
    blocks = _blocks(light, total, block_tokens, shard_tokens).select("_source", "_shard", "_block").distinct()
    found = allotted(_counted(blocks), WEIGHTS if weights is None else weights, other, _seats(tokens, block_tokens))
    whole, all_taken = sum(w for _, w, _, _ in found), sum(taken for *_, taken in found)
    out = [(s, n, taken, taken / n, taken / max(1, all_taken) - float(w / whole if whole else 0)) for s, w, n, taken in found]
    return docs.sparkSession.createDataFrame(out, "source string, blocks long, taken long, kept_share double, deviation double")


def query(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


def query_whole(spark, sf_dir: str) -> DataFrame:
    """As query, but the whole corpus is the budget, however scarce a source is."""
    return plan(table(spark, sf_dir, "documents"), tokens=WHOLE)


def _oracle() -> str:
    weight = "case " + " ".join(f"when source = '{s}' then {w}" for s, w in WEIGHTS.items()) + f" else {OTHER_WEIGHT} end"
    return f"""with d as (select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) as tokens, md5('{SEED}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) as ord from documents),
    s as (select *, ('0x' || substr(ord, 1, 8))::bigint % greatest(1, ceil((select sum(tokens) from d) / {SHARD_TOKENS}.0)::bigint) as shard from d),
    b as (select doc_id, source, shard, tokens, ((sum(tokens) over (partition by source, shard order by ord, tokens rows unbounded preceding) - tokens) // {BLOCK_TOKENS})::bigint as block from s),
    bl as (select distinct source, shard, block from b),
    av as (select source, count(*) as n, {weight} as w from bl group by source),
    seats as (select min((n * (select sum(w) from av)) // w) as total from av where w > 0),
    q as (select source, row_number() over (order by w::double / (2 * k + 1) desc, source) as r from (select source, w, unnest(range(n)) as k from av where w > 0)),
    by_source as (select source, count(*) as quota from q where r <= (select total from seats) group by source),
    sh as (select source, shard, count(*) as n from bl group by all),
    qs as (select source, shard, row_number() over (partition by source order by n::double / (2 * k + 1) desc, shard) as r from (select source, shard, n, unnest(range(n)) as k from sh)),
    by_shard as (select qs.source, shard, count(*) as quota from qs join by_source using (source) where r <= quota group by all),
    ranked as (select *, row_number() over (partition by source, shard order by md5('{SEED}:' || source || ':' || shard || ':' || block)) as nth from bl)
    select doc_id, source, shard, block, tokens::bigint as tokens from b join ranked using (source, shard, block) join by_shard using (source, shard) where nth <= quota"""


ORACLE = _oracle()
#: With every block taken, what is left to check is how documents are placed.
ORACLE_WHOLE = ORACLE[: ORACLE.index(",\n    bl as")] + "\n    select doc_id, source, shard, block, tokens::bigint as tokens from b"
