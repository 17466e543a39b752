"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is dealt in blocks of equally many words. Sources get blocks by the highest quotients of their targets, the
shards of a source by the highest quotients of their sizes. A shard's documents stand in a seeded order and form
one run of words, cut into blocks; it takes whole passes over the run and then the blocks that a seeded permutation
puts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Factors of block permutations: primes that no number of blocks in a shard has as a divisor, as they are larger.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: the sum of all sizes shared by weight, no target above ``cap`` times its size.

    Sources by code point, null last, take the weights in turn. The excess over a cap is shared again by weight,
    which comes to one level: those of the smallest cap for their weight are full, all others stand at the level
    times their weight. Runs in one task over a row per source.
    """
    # one row per source, so a window over all of them is small
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    ranked = sizes.select("*", weight.alias("w")).withColumn("most", F.col("source_size") * float(cap))
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    ranked = ranked.withColumn("left", F.col("total") - F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("most")).withColumn("w_left", F.sum("w").over(rest))
    ranked = ranked.withColumn("full", F.col("left") * F.col("w") >= F.col("most") * F.col("w_left"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("most")).otherwise(level * F.col("w"))
    return ranked.select(*sizes.columns, target.alias("target"))


def sainte_lague(df: DataFrame, groups: list[str], unit: str, votes: str, seats: Column) -> DataFrame:
    """Adds ``quota``: ``seats`` of each group dealt to its units by the highest quotients votes / (2 k + 1), ties by the unit's hash.

    Rounding votes to the nearest multiple of votes / seats is itself such an apportionment, of about as many seats.
    The few missing seats go to the next highest quotients and surplus ones leave at the lowest, which gives the same
    quotas as dealing every seat in turn.
    """
    whole = Window.partitionBy(*groups)
    near = df.withColumn("__v", F.col(votes).cast("double")).withColumn("__all", F.sum("__v").over(whole)).withColumn("__n", F.count("*").over(whole)).withColumn("__seats", seats.cast("long"))
    near = near.withColumn("__q", F.when(F.col("__all") > 0, F.floor(F.col("__v") * F.col("__seats") / F.col("__all") + 0.5)).otherwise(0).cast("long"))
    near = near.withColumn("__miss", F.when(F.col("__all") > 0, F.col("__seats") - F.sum("__q").over(whole)).otherwise(0))
    most = (F.ceil((F.abs("__miss") + F.col("__n")) * F.col("__v") / F.col("__all")) + 1).cast("int")
    step = near.where((F.col("__miss") != 0) & (F.col("__v") > 0)).select(*groups, unit, "__v", "__q", "__miss", F.explode(F.sequence(F.lit(1), most)).alias("j"))
    step = step.where((F.col("__miss") > 0) | (F.col("j") <= F.col("__q")))
    quotient = F.when(F.col("__miss") > 0, -F.col("__v") / (2 * (F.col("__q") + F.col("j")) - 1)).otherwise(F.col("__v") / (2 * (F.col("__q") - F.col("j")) + 1))
    order = Window.partitionBy(*groups).orderBy(quotient, F.when(F.col("__miss") > 0, F.lit(1)).otherwise(-1) * F.hash(unit), unit)
    moved = step.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.abs("__miss")).groupBy(*groups, unit).agg((F.count("*") * F.signum(F.first("__miss"))).cast("long").alias("__moved"))
    moved = moved.select(*[F.col(c).alias(f"__m_{c}") for c in [*groups, unit]], "__moved")
    on = [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in [*groups, unit]]
    out = near.join(moved, on, "left")
    return out.select(*df.columns, (F.col("__q") + F.coalesce("__moved", F.lit(0))).alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, block_words: int = 64, shard_words: int = 1 << 19, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, shard`` of every row of ``docs(doc_id, text, source)``.

    ``taken`` counts the words that the mix takes of a document, repeats counted; at most ``cap`` times its size. A
    null or empty text has no word, a long one is counted whole. A null source is a source of its own. Repeated rows
    are taken each for itself, ties stand in the order of doc_id and size. Other columns are not read. Less than half a
    block in all gives nothing. The same rows and seed give the same mix.
    """
    space = Workspace(docs.sparkSession, "mix")
    sized = space.keep(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("place")), "sized")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    seats = F.round(F.sum("source_size").over(Window.partitionBy()) / block_words)
    sources = sainte_lague(sources.withColumn("one", F.lit(0)).withColumn("seats", seats), ["one"], "source", "target", F.col("seats")).drop("one", "seats")
    sources = space.keep(sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))), "sources")
    info = sources.select(F.col("source").alias("__source"), "source_size", "target", F.col("quota").alias("blocks"), "shards")
    placed = sized.join(info, sized["source"].eqNullSafe(info["__source"]), "left").withColumn("shard", F.pmod("place", "shards").cast("int"))
    by_shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("length"), F.first("blocks").alias("blocks"))
    quotas = sainte_lague(by_shard, ["source"], "shard", "length", F.col("blocks")).select(F.col("source").alias("__s"), F.col("shard").alias("__k"), "length", "quota")
    rows = placed.join(quotas, placed["source"].eqNullSafe(quotas["__s"]) & (placed["shard"] == quotas["__k"]), "left")

    end = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    words = F.least(F.col("quota") * block_words, F.col("length") * cap)
    rows = rows.withColumn("end", end).withColumn("words", words).withColumn("passes", F.when(F.col("length") > 0, F.floor(F.col("words") / F.col("length"))).otherwise(0))
    rows = rows.withColumn("rest", F.col("words") - F.col("passes") * F.col("length"))
    # whole blocks are numbered anew by a seeded permutation, j -> (a j + b) mod their number; a last shorter one stays last
    full, lot = F.floor(F.col("length") / block_words), F.xxhash64("source", "shard", F.lit(seed))
    factor = F.get(F.array(*[F.lit(p) for p in PRIMES]), F.pmod(lot, F.lit(len(PRIMES))).cast("int"))
    rows = rows.withColumns({"begin": F.col("end") - F.col("size"), "full": full, "factor": factor, "shift": F.pmod(lot, F.greatest(full, F.lit(1)))})
    rows = rows.withColumns({"whole": F.floor(F.col("rest") / block_words), "part": F.pmod("rest", F.lit(block_words))})

    def taken_of(j: Column) -> Column:
        """Words that the mix takes of the document's part of block ``j``."""
        at = F.when(j >= F.col("full"), F.col("full")).otherwise(F.pmod(j * F.col("factor") + F.col("shift"), F.greatest("full", F.lit(1))))
        wanted = F.when(at < F.col("whole"), block_words).when(at == F.col("whole"), F.col("part")).otherwise(0)
        return F.greatest(F.least(F.col("end"), j * block_words + wanted) - F.greatest(F.col("begin"), j * block_words), F.lit(0)).cast("long")

    blocks = F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))
    some = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(blocks, F.lit(0).cast("long"), lambda n, j: n + taken_of(j))).otherwise(0)
    taken = F.col("passes") * F.col("size") + some
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard")
