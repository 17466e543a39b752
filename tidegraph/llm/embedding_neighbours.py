"""Near-duplicate embeddings by NN-descent.

The neighbour graph starts from blocks of vectors with like sign codes and is refined by local joins: whatever two
neighbours of one vector are, they are compared with each other. The search runs on 8-bit copies of the vectors;
links are decided in double precision on the vectors themselves. A list that is full of links is enlarged. An audit
compares a bounded sample with all vectors; below the wanted recall the search goes on with new codes, and raises
when that doesn't help. Beyond ``GROWS`` vectors every doubling adds a code and a round. Inside a
component the links are at last counted exactly, block by block, so groups larger than any list lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.workspace import Workspace, components

GRAPH = "a long, b long, s float"
#: How far the cosine of the 8-bit copies may lie below that of the vectors.
MARGIN = 0.03
#: Blocks on a side of what one key of the count compares.
SQUARE = 32
#: Vectors from which on codes and rounds grow, and the turns after which a search that misses its recall raises.
GROWS, TURNS = 1 << 16, 8


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best different neighbours ``b`` of each ``a``."""
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, int)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    keep = rank < k
    return pd.DataFrame({"a": a[keep], "b": b[keep], "s": s[keep].astype(np.float32)})


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _unit8(small: np.ndarray) -> np.ndarray:
    x = small.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, small`` of the vectors that can link: unit vectors as doubles and their 8-bit copies, both as bytes."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out, small = [], [], []
            for vec_id, x in zip(batch["vec_id"], batch["embedding"], strict=True):
                x = np.array(x, np.float64)  # a null component reads as NaN
                if x.size and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    x = x / np.linalg.norm(x)
                    ids.append(vec_id)
                    out.append(x.tobytes())
                    small.append(np.round(x * (127 / np.abs(x).max())).astype(np.int8).tobytes())
            yield pd.DataFrame({"vec_id": np.array(ids, np.int64), "v": out, "small": small})

    usable = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return usable.mapInPandas(clean, "vec_id long, v binary, small binary")


def _coded(nodes: DataFrame, seed: int, bits: int, block: int, k: int) -> DataFrame:
    """Edges between vectors that stand near each other in the order of a random sign code."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _rows(b["small"], np.int8).astype(np.float32)
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits + 1)).astype(np.float32)
                p = x @ planes
                yield b.assign(code=((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64), along=p[:, bits].astype(np.float64))

    def near(b: pd.DataFrame) -> pd.DataFrame:
        ids = b["vec_id"].to_numpy()
        x = _unit8(_rows(b["small"], np.int8))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        n = min(k, len(ids) - 1)
        best = np.argpartition(-s, n - 1, 1)[:, :n]
        return _top(np.repeat(ids, n), ids[best].reshape(-1), np.take_along_axis(s, best, 1).reshape(-1), k)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:  # blocks overlap by half, whatever the size of the batches
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= 2 * block:
                yield near(held.iloc[: 2 * block])
                held = held.iloc[block:]
        if held is not None and len(held) > 1:
            yield near(held)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = nodes.select("vec_id", "small").mapInPandas(code, "vec_id long, small binary, code long, along double")
    placed = coded.repartitionByRange(parts, "code", "along", "vec_id").sortWithinPartitions("code", "along", "vec_id")
    return placed.mapInPandas(link, GRAPH)


def _best(graph: DataFrame, full: DataFrame | None, k: int, wide: int) -> DataFrame:
    """The best ``k`` edges of each vector, ``wide`` for those in ``full``."""
    once = graph.groupBy("a", "b").agg(F.max("s").alias("s"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b")))
    if full is None:
        return ranked.where(F.col("r") <= k).drop("r")
    ranked = ranked.join(full.select("a", F.lit(wide).alias("most")), "a", "left")
    return ranked.where(F.col("r") <= F.coalesce("most", F.lit(k))).select("a", "b", "s")


def _local_join(graph: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """New edges among the neighbours, and reverse neighbours, of every vector."""
    bar = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-1.0)).cast("float").alias("bar"))
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b", F.lit(seed)), "b"))).where(F.col("r") <= k).drop("r")
    around = graph.select("a", "b").union(back).distinct()
    member = nodes.select(F.col("vec_id").alias("b"), "small").join(bar.withColumnRenamed("a", "b"), "b", "left")
    lists = around.join(member, "b").groupBy("a").agg(F.collect_list("b").alias("ids"), F.collect_list("small").alias("small"), F.collect_list(F.coalesce("bar", F.lit(-1.0).cast("float"))).alias("bars"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                found: tuple[list, list, list] = ([], [], [])
                for ids, small, bars in zip(*[batch[c].iloc[lo : lo + 2000] for c in ("ids", "small", "bars")], strict=True):
                    if len(ids) < 2:
                        continue
                    x = _unit8(np.frombuffer(b"".join(small), np.int8).reshape(len(ids), -1))
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    i, j = np.nonzero(s > bars[:, None])
                    for out, part in zip(found, (ids[i], ids[j], s[i, j]), strict=True):
                        out.append(part)
                if found[0]:
                    yield _top(*[np.concatenate(x) for x in found], 2 * k)

    return lists.select("ids", "small", "bars").mapInPandas(compare, GRAPH)


def _links(graph: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The edges of the graph that hold in double precision."""
    maybe = graph.where(F.col("s") >= cosine - MARGIN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = maybe.join(nodes.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[np.einsum("ij,ij->i", _rows(b["va"], np.float64), _rows(b["vb"], np.float64)) >= cosine, ["a", "b"]]

    return both.mapInPandas(decide, "a long, b long")


def missed_share(nodes: DataFrame, label: DataFrame, cosine: float, sample: int, seed: int) -> float:
    """Of the linked vectors of a bounded sample, compared with all, the share with a link that joins different components.

    Each vector counts once, so a large group doesn't hide what small ones miss.
    """
    picked = nodes.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec_id", "v").toPandas()
    if not len(picked):
        return 0.0
    ids = picked["vec_id"].to_numpy()
    x = _rows(picked["v"], np.float64)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                i, j = np.nonzero(x @ _rows(b["v"], np.float64).T >= cosine)
                other = b["vec_id"].to_numpy()[j]
                yield pd.DataFrame({"a": ids[i], "b": other})[ids[i] != other]

    pairs = nodes.select("vec_id", "v").mapInPandas(look, "a long, b long")
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    n, missed = joined.groupBy("a").agg(F.max(apart).alias("missed")).agg(F.count("*"), F.count(F.when(F.col("missed"), 1))).first()
    return missed / n if n else 0.0


def _counted(nodes: DataFrame, label: DataFrame, cosine: float, block: int, space: Workspace, tag: str) -> DataFrame:
    """``node, partners``: the links of every vector inside its component, copies included, by comparing blocks.

    Only counts leave a task: the pairs of a component are not written. A component of many blocks is dealt out in
    squares of ``SQUARE`` by ``SQUARE`` blocks, so a large one is spread over tasks.
    """
    own = nodes.join(label.withColumnRenamed("node", "vec_id"), "vec_id")
    size = space.keep(label.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), f"{tag}sizes")
    salt = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = own.join(size, "component").withColumn("block", salt).withColumn("bands", F.ceil(F.col("blocks") / SQUARE).cast("int"))
    packed = dealt.repartition("component", "block").groupBy("component", "bands", "block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"), F.collect_list("copies").alias("copies"))
    mine, every = F.floor(F.col("block") / SQUARE).cast("int"), F.explode(F.sequence(F.lit(0), F.col("bands") - 1))
    left = packed.select("component", mine.alias("i"), every.alias("j"), F.col("ids").alias("ia"), F.col("vs").alias("xa"))
    right = packed.select("component", mine.alias("j"), every.alias("i"), F.col("ids").alias("ib"), F.col("vs").alias("xb"), F.col("copies").alias("wb"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ia, xa, ib, xb, wb in zip(b["ia"], b["xa"], b["ib"], b["xb"], b["wb"], strict=True):
                s = np.frombuffer(b"".join(xa), np.float64).reshape(len(ia), -1) @ np.frombuffer(b"".join(xb), np.float64).reshape(len(ib), -1).T
                hit = (s >= cosine) & (np.asarray(ia)[:, None] != np.asarray(ib)[None, :])
                out.append(pd.DataFrame({"node": ia, "partners": hit @ np.asarray(wb)}))
            yield pd.concat(out) if out else pd.DataFrame({"node": [], "partners": []})

    counts = left.join(right, ["component", "i", "j"]).select("ia", "xa", "ib", "xb", "wb").mapInPandas(count, "node long, partners long")
    return counts.groupBy("node").agg(F.sum("partners").alias("partners"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, k: int = 12, codes: int = 4, bits: int = 12, block: int = 128, rounds: int = 3, recall: float = 0.99, sample: int = 256, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    Vectors link when their cosine in double precision is at least ``cosine``. ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` says that it is the row's own. A
    vector that is null, empty or zero or holds a null or non-finite component links with nothing, and vectors of
    different lengths don't link; each length that occurs has a search of its own. Equal vectors are one node of the
    graph. A row without vec_id links with nothing, has a null component and isn't kept. Of rows that repeat a vec_id,
    each has the most links and the least component of them. Ties of similarity go by vec_id. Other columns are not
    read. Raises if the audit still misses ``recall`` after ``TURNS`` turns.
    """
    space = Workspace(vectors.sparkSession, "neighbours")
    clean = space.keep(clean_vectors(vectors), "clean")
    classes = space.keep(clean.groupBy("v").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"), F.first("small").alias("small")), "classes")
    nodes = classes.select(F.col("head").alias("vec_id"), "v", "small", "copies")
    label, counts = _no_rows(space, "node long, component long"), _no_rows(space, "node long, partners long")
    # one search for each length that occurs
    for size in sorted(r.n for r in nodes.select(F.length("small").alias("n")).distinct().collect()):
        own, partners = _search(nodes.where(F.length("small") == size), space, f"{size}-", cosine, k, codes, bits, block, rounds, recall, sample, seed)
        label, counts = label.union(own), counts.union(partners)

    by_class = classes.select("v", "head", "copies").join(label.withColumnRenamed("node", "head"), "head", "left").join(counts.withColumnRenamed("node", "head"), "head", "left")
    known = clean.select("vec_id", "v").join(by_class.select("v", F.coalesce("component", "head").alias("c"), (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n")), "v").groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _no_rows(space: Workspace, schema: str) -> DataFrame:
    return space.spark.createDataFrame([], schema)


def _search(nodes: DataFrame, space: Workspace, tag: str, cosine: float, k: int, codes: int, bits: int, block: int, rounds: int, recall: float, sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``node, component`` and ``node, partners`` of vectors of one length."""
    graph = label = None
    more = max(0, (nodes.count() // GROWS).bit_length())
    codes, rounds = codes + more, rounds + more
    for turn in range(TURNS):
        fresh = graph
        for c in range(codes):
            part = _coded(nodes, seed + 1000 * turn + c, bits, block, k)
            fresh = part if fresh is None else fresh.union(part)
        graph = space.keep(_best(fresh, None, k, k), f"{tag}graph{turn}")
        for r in range(rounds):
            # a list full of links may have more of them: it may grow
            full = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("low")).where((F.col("n") >= k) & (F.col("low") >= cosine - MARGIN)).select("a")
            nxt = space.keep(_best(graph.union(_local_join(graph, nodes, k, seed + r)), full, k, 4 * k), f"{tag}graph{turn}.{r}")
            changed = nxt.join(graph, ["a", "b"], "left_anti").count()
            graph = nxt
            if changed <= 0.01 * nxt.count():
                break
        links = space.keep(_links(graph, nodes, cosine), f"{tag}links{turn}")
        label = space.keep(components(links, space, f"{tag}cc{turn}-"), f"{tag}label{turn}")
        if 1 - missed_share(nodes, label, cosine, sample, seed + turn) >= recall:
            break
    else:
        raise RuntimeError(f"recall stays below {recall} after {TURNS} turns")
    return label, space.keep(_counted(nodes, label, cosine, 128, space, tag), f"{tag}counts")
