"""N-gram Jaccard join by prefix filters under several global token orders.

Two shingle sets of Jaccard at least ``t`` share a token among the first ``n - ceil(t n) + 1`` of each, whatever
the order of the tokens. Three orders are used: one that puts tokens often met in the corpus last, and two by
independent hashes. A pair is a candidate if it shares a prefix token under all three; only then the whole sets are
compared, exactly. Before that a parity bitmap of each set, about two bits a token, bounds how much the two differ:
tokens of one set only flip bits, so bitmaps never differ in more places than the sets do.

Equal sets form one class, which is linked through its smallest document. Among the documents of one prefix token
of the first order, all are first compared with the smallest; what is then still apart is compared pair by pair,
within slots of comparable set size. Pairs already known to be connected need no comparison, so a large group of
near copies costs its size, not its square, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.worker_memory import held
from tidegraph.llm.workspace import Workspace, components, only

CELLS = 1 << 16
KNOWN_WORDS = 200_000
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles: A-Z lower-cased, words parted by ASCII white space.

    A text of fewer words than ``width`` has one shingle, all its words; without words it has none.
    """
    words = [t.encode().lower().split() if t else [] for t in texts]
    known = held("words", WordHashes)
    h = np.array([x for w in words if len(w) >= width for x in map(known.__getitem__, w)], np.uint64)
    n = max(len(h) - width + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = _mix(mixed + h[k : k + n] * _MULTIPLIERS[k % 3], k + 1)
    out, at = [], 0
    for w in words:
        if len(w) >= width:
            x = np.sort(mixed[at : at + len(w) - width + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
            at += len(w)
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))] if w else [], np.uint64))
    return out


def _blocks(batches: Iterator[pd.DataFrame], width: int, size: int = 256) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for b in batches:
        for k in range(0, len(b), size):
            part = b.iloc[k : k + size]
            yield part, shingle_sets(part["text"].tolist(), width)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(48)).astype(np.int64)


def cell_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all documents fall into each of ``CELLS`` hash cells; what ranks the first order."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for _, sets in _blocks(batches, width):
            total += np.bincount(_cells(np.concatenate(sets)), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bitmap with one bit for each residue of the hash, set where an odd number of tokens falls; 2 to 4 bits a token.

    Its length is a power of two, so a longer one folds to the length of a shorter one.
    """
    size = max(64, 1 << int(2 * len(tokens)).bit_length())
    at = (_mix(tokens, 0x2545F491) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """In how many places two parity bitmaps differ, at the length of the shorter; at most the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def signatures(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """``doc_id, n, same, p1, p2, p3, bits``: ``same`` is equal for equal sets, the next are prefixes under the three orders.

    Each prefix holds n - ceil(t n) + 1 tokens, of which linked sets share one. ``p1`` is in its order; ``p2`` and
    ``p3`` keep 32 bits. ``bits`` is the parity bitmap.
    """
    rank = np.empty(CELLS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(CELLS, dtype=np.uint64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _blocks(batches, width):
            flat = np.concatenate(sets)
            # the cell is the upper 16 bits of a token, so this is one order of all tokens
            rare = rank[_cells(flat)] << np.uint64(48) | flat & np.uint64((1 << 48) - 1)
            orders = [rare, _mix(flat, 0x5851F42D), _mix(flat, 0x14057B7E)]
            rows, at = [], 0
            for doc, tokens in zip(part["doc_id"], sets, strict=True):
                n = len(tokens)
                if not n:
                    rows.append((doc, 0, None, [], [], [], None))
                    continue
                spare = n - (percent * n + 99) // 100
                first, second, third = [np.partition(o[at : at + n], spare)[: spare + 1].view(np.int64) for o in orders]
                rows.append((doc, n, xxhash.xxh3_128_digest(tokens.tobytes()), np.sort(first.view(np.uint64)).view(np.int64), (second >> 32).astype(np.int32), (third >> 32).astype(np.int32), parity_bits(tokens)))
                at += n
            yield pd.DataFrame(rows, columns=["doc_id", "n", "same", "p1", "p2", "p3", "bits"])

    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, n long, same binary, p1 array<long>, p2 array<int>, p3 array<int>, bits binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, tokens``: whole sets."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _blocks(batches, width):
            yield pd.DataFrame({"doc_id": part["doc_id"], "tokens": [x.view(np.int64) for x in sets]})

    return docs.select("doc_id", "text").mapInPandas(build, "doc_id long, tokens array<long>")


def _comparable(percent: int):
    return (F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)


def _in_time(percent: int):
    """Whether a shared token stands early enough in both prefixes: the first one shared has at places ``pa, pb`` no
    more than so many tokens left to share."""
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return left * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _filtered(pairs: DataFrame, sigs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Of pairs ``a, b`` of documents among ``ids`` those that share prefix tokens under the other orders as well and
    whose bitmaps differ in no more places than linked sets may."""
    sigs = only(sigs.where("n > 0").select("doc_id", "n", "p2", "p3", "bits"), ids, "doc_id")
    side = lambda c: sigs.select(F.col("doc_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "p2", "p3", "bits")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            apart = np.array([differing_bits(*both) for both in zip(x["a_bits"], x["b_bits"], strict=True)], np.int64)
            yield x.loc[apart * (100 + percent) <= x["size"].to_numpy() * (100 - percent), ["a", "b"]]

    return met.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("size"), "a_bits", "b_bits").mapInPandas(bound, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    mine = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(mine, "a").join(other, "b")
    common = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("i"), (F.size("ta") + F.size("tb")).cast("long").alias("s"))
    return common.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b").distinct()


def _met(rows: DataFrame, on: list[str], percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components and comparable size that meet in ``on``."""
    left = rows.select(*on, F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("place").alias("pa"))
    right = rows.select(*on, F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("place").alias("pb"))
    return left.join(right, on).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _comparable(percent) & _in_time(percent)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, crowd: int = 16) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets. ``component_id`` is the
    smallest doc_id reachable by links, itself included. Documents that meet at a token more than ``crowd`` at a time
    are joined by a prefix order of their own, with exact counts. A text that is null or has no word has no shingle and
    links with nothing. Rows that repeat a doc_id stay rows; if their texts differ, the document has the links of
    both. Rows without doc_id link with nothing and get a null component.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    sigs = space.keep(signatures(docs, cell_counts(docs, width), width, percent), "signatures")
    class_of = space.keep(sigs.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("head")), "classes")
    heads = class_of.select(F.col("head").alias("doc_id")).distinct()

    def ids_of(pairs: DataFrame, name: str) -> DataFrame:
        return space.keep(_ids(pairs), f"{name}-ids")

    def candidates(pairs: DataFrame, name: str) -> DataFrame:
        pairs = space.keep(pairs, f"{name}-pairs")
        found = space.keep(_filtered(pairs, sigs, ids_of(pairs, f"{name}-pair"), percent), f"{name}-candidates")
        space.drop(f"{name}-pairs")
        space.drop(f"{name}-pair-ids")
        return found

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs."""
        sets = space.keep(_sets(only(docs, ids_of(pairs, f"{name}-candidate"), "doc_id"), width), f"{name}-sets")
        links = space.keep(_verified(pairs, sets, percent), f"{name}-links")
        space.drop(f"{name}-sets")
        return links

    by_token = Window.partitionBy("token")
    tokens = only(sigs.where("n > 0").select("doc_id", "n", "p1"), heads, "doc_id").select("doc_id", "n", F.posexplode("p1").alias("place", "token"))
    lead = F.min(F.struct("doc_id", "n", "place")).over(by_token)
    shared = tokens.withColumn("lead", lead).withColumn("hi", F.max("doc_id").over(by_token)).withColumn("df", F.count("*").over(by_token)).where("lead.doc_id < hi")
    kept = space.keep(shared.select("token", "df", "doc_id", "n", "place", F.col("lead.doc_id").alias("a"), F.col("lead.n").alias("na"), F.col("lead.place").alias("pa")), "kept")

    star = kept.where("doc_id > a").withColumnRenamed("doc_id", "b").withColumnRenamed("n", "nb").withColumnRenamed("place", "pb").where(_comparable(percent) & _in_time(percent)).select("a", "b").distinct()
    stars = linked(candidates(star, "star"), "star")
    label = components(stars, space, "first")

    # what is still apart among the documents of a token, by slots: sizes within the ratio meet in one slot at least
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.001 + 1e-9))
    # all pairs with a token's first document are compared by now, so tokens of two documents are done
    placed = kept.where("df > 2 and doc_id <> a").select("token", "doc_id", "n", "place").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # most tokens stand in one component alone by now
    torn = space.keep(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token"), "torn-tokens")
    torn = space.keep(placed.join(torn, "token"), "torn")  # a table on either side, so that a skewed join can be split
    space.drop("kept")
    apart = torn.select("token", "doc_id", "n", "place", "component", F.explode(F.array(size_class, size_class + 1)).alias("slot"))
    mixed = space.keep(apart.groupBy("token", "slot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("token", "slot", "size"), "mixed")
    apart = space.keep(apart.join(mixed, ["token", "slot"]), "apart")
    space.drop("torn")
    few = candidates(_met(apart.where(F.col("size") <= crowd), ["token", "slot"], percent), "few")
    # documents that crowd at a token: their own exact counts give an order with the rarest tokens first
    crowded = space.keep(apart.where(F.col("size") > crowd).select("doc_id", "n", "component").distinct(), "crowded")
    space.drop("apart")
    own = space.keep(_sets(only(docs, crowded.select("doc_id").distinct(), "doc_id"), width), "crowded-sets").join(crowded, "doc_id").select("doc_id", "n", "component", F.explode("tokens").alias("token"))
    often = own.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = own.join(often, "token")
    # tokens that no other crowded document has come first and fill the prefix without meeting anything
    alone = F.col("n") - F.count("*").over(Window.partitionBy("doc_id"))
    placed = met.withColumn("place", alone + F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token")) - 1)
    prefix = space.keep(placed.where(F.col("place") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100)).select("doc_id", "n", "component", "token", "place"), "prefix")
    space.drop("crowded-sets")
    many = candidates(_met(prefix, ["token"], percent), "many")
    space.drop("prefix")
    rows = space.keep(sigs.select("doc_id", "n", "same"), "rows")
    space.drop("signatures")
    label = space.keep(components(stars.union(linked(few.union(many).distinct(), "rest")), space, "second"), "labels")

    by_class = class_of.join(label.withColumnRenamed("node", "head"), "head", "left").select("same", F.coalesce("component", "head").alias("component"))
    out = rows.join(by_class, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
