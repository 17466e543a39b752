"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents of equal text form a group and stay in one shard, and every group is packed itself, by the same steps whatever
their number. Groups with a large share of a total come first, on the driver. All others are dealt by hash to ``lanes``
that are packed side by side, each onto its part of what the large ones left. A lane holds back a few groups, chosen by
hash; these come last, on the driver, and even out what the lanes left. What the driver packs is bounded by parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.source_mixing import word_count
from tidegraph.llm.workspace import Workspace

DIMENSIONS = ["bytes", "tokens", "rows"]


def pack(vectors: np.ndarray, residual: np.ndarray, later: np.ndarray | float = 0.0, exact: bool = True) -> np.ndarray:
    """The shard of each item. ``vectors`` (n, d) are shares of the totals; ``residual`` (shards, d) is what the shards
    have left, which the items use up. ``later`` is what others will put there afterwards.

    What a shard has left should shrink in proportion to what is still to come; an item goes where item . (residual
    beyond that) is highest, each dimension counted in units of what is to come. ``exact`` takes items with most bytes
    (the first dimension) first, and only shards whose bytes have room, or where none has, the one with most bytes left.
    So bytes come out nearly equal, the other dimensions as equal as that allows. Otherwise items are taken as they stand.
    """
    out = np.zeros(len(vectors), np.int64)
    if not len(vectors):
        return out
    order = np.lexsort((-vectors.max(1), -vectors[:, 0])) if exact else np.arange(len(vectors))
    coming = np.maximum(np.cumsum(vectors[order][::-1], 0)[::-1] + later, 1e-150)
    pull = vectors[order] / (coming if exact else coming[:1]) ** 2
    room = residual / coming[:1]
    for i, to_come, weighed in zip(order, coming, pull):
        item = vectors[i]
        score = (residual - room * to_come) @ weighed
        if exact:
            fits = residual[:, 0] >= item[0]
            score = np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]
        k = int(np.argmax(score))
        out[i] = k
        residual[k] -= item
    return out


def shard_documents(docs: DataFrame, shards: int = 8, heavy_share: int = 4096, lanes: int = 64, spare: int = 128, cells: int = 512) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs(doc_id, text)``; the law is ``bytes``.

    Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one. A group of more than a shard's
    capacity in some dimension can't stay whole: it is dealt in pieces by doc_id. Groups with more than a
    ``heavy_share``-th of a total are packed first, so there are at most 3 * heavy_share of those, besides pieces; each
    of the ``lanes`` holds back ``spare`` groups for the end. Texts are measured whole. Rows that repeat a
    doc_id, or have none, are rows like others; other columns are not read. Slots count from 0 in every shard, by ``cells``
    of a hash, then doc_id; rows that are alike in every column may change places.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = space.keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), word_count().alias("words"), F.xxhash64(text, F.length(text)).alias("group")), "rows")
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("rows")]
    groups = space.keep(rows.groupBy("group").agg(*sums), "groups")
    totals = groups.agg(*[F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1)).alias(c) for c in DIMENSIONS]).first()
    whole = np.array([totals[c] for c in DIMENSIONS], float)
    share = F.greatest(*[F.col(c) / float(totals[c]) for c in DIMENSIONS])
    pieces = F.when(share * shards > 1, F.ceil(share * shards * 4)).otherwise(1).cast("int")
    # at most 3 * heavy_share rows: each has more than that part of some total
    heavy = F.broadcast(groups.where(share > 1.0 / heavy_share).select("group", pieces.alias("pieces")))
    place = F.xxhash64("doc_id", "group")
    wide = rows.join(heavy, "group", "left").withColumn("piece", F.coalesce(F.pmod(place, "pieces"), F.lit(-1)).cast("int"))

    first = wide.where("piece >= 0").groupBy("group", "piece").agg(*sums).toPandas().sort_values(["group", "piece"])
    amounts = first[DIMENSIONS].to_numpy(float)
    later = np.maximum(whole - amounts.sum(0), 0) / whole
    residual = np.full((shards, len(DIMENSIONS)), 1.0 / shards)
    first["shard"] = pack(amounts / whole, residual, later)
    after = residual / np.maximum(later, 1e-150)

    def fill(lane: pd.DataFrame) -> pd.DataFrame:
        """``shard`` of a lane's groups, taken by hash; -1 for the first ones, which are held back."""
        lane = lane.sort_values("group")
        vectors = lane[DIMENSIONS].to_numpy(float)[spare:] / whole
        # lanes begin at different shards, so that what they can't even out doesn't add up
        order = (np.arange(shards) + int(lane["lane"].iloc[0])) % shards
        to = order[pack(vectors, (after * vectors.sum(0))[order], exact=False)]
        return lane.assign(shard=np.concatenate([np.full(len(lane) - len(to), -1), to]))[["group", *DIMENSIONS, "shard"]]

    light = groups.where(share <= 1.0 / heavy_share).withColumn("lane", F.pmod("group", F.lit(lanes)).cast("int"))
    filled = space.keep(light.groupBy("lane").applyInPandas(fill, "group long, bytes long, tokens long, rows long, shard int"), "filled")
    for load in filled.where("shard >= 0").groupBy("shard").agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).collect():
        residual[load["shard"]] -= np.array([load[c] for c in DIMENSIONS], float) / whole
    last = filled.where("shard < 0").toPandas().sort_values("group").assign(piece=-1)
    last["shard"] = pack(last[DIMENSIONS].to_numpy(float) / whole, residual)

    # large groups with their pieces, and those held back: bounded by the parameters
    known = F.broadcast(_table(spark, pd.concat([first, last]), "group long, piece int, shard int"))
    cell = F.pmod(F.shiftright(place, 20), F.lit(cells)).cast("int").alias("cell")
    # no group here has more than a heavy_share-th of the rows
    others = wide.where("piece < 0").join(filled.where("shard >= 0").select("group", "shard").hint("merge"), "group")
    both = [part.select("doc_id", "size", "text_crc32", "group", "shard", cell) for part in (wide.join(known, ["group", "piece"]), others)]
    placed = space.keep(both[0].unionAll(both[1]), "placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).toPandas().sort_values(["shard", "cell"])
    counts["start"] = counts.groupby("shard")["n"].cumsum() - counts["n"]
    starts = F.broadcast(_table(spark, counts, "shard int, cell int, start long"))
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "group")) - 1
    return placed.join(starts, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _table(spark: SparkSession, frame: pd.DataFrame, schema: str) -> DataFrame:
    kinds = {name: {"int": "int32", "long": "int64"}[kind] for name, kind in (c.split() for c in schema.split(", "))}
    return spark.createDataFrame(frame[list(kinds)].astype(kinds), schema)
