"""Line-level deduplication by pairwise alignment.

Overlapping documents are found through hashes that they share: of short runs of lines, the shortest from each line on
and the shortest up to each line that hold ``min_words`` words, so that every line of a common block is in a run
inside the block. Each run pairs a document with the earliest one that has it, however often it is met. A pair is
aligned by patience diff over the lines its runs span, and aligned blocks of ``min_words`` words go from the later
document. A shared run that this leaves out, as its block is repeated or moved, begins another alignment, which is
held together at that run; so every block that an earlier document has goes, wherever it stands in it. Later whole
copies of a text go at once, and are not aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.workspace import Workspace, fresh

WORD = r"[^\x20\x09-\x0D]+"
BASE = 0x9E3779B97F4A7C15


def _anchors(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Lines that occur once in each range, in the longest chain that rises in both."""
    ca, cb = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    at = {h: k for k, h in enumerate(b[lo_b:hi_b], lo_b) if cb[h] == 1 and ca.get(h) == 1}
    pairs = [(k, at[h]) for k, h in enumerate(a[lo_a:hi_a], lo_a) if h in at]
    tails: list[int] = []
    best: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        if n == len(tails):
            tails.append(j)
            best.append(k)
        else:
            tails[n], best[n] = j, k
        back.append(best[n - 1] if n else -1)
    chain, k = [], best[-1] if best else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _rarest(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """The rarest line common to both ranges, at its middle occurrence in each; nothing if there is none."""
    ca, cb = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    common = [(n * cb[h], h) for h, n in ca.items() if h in cb]
    if not common:
        return []
    h = min(common)[1]
    middle = lambda x, lo, hi, n: [k for k in range(lo, hi) if x[k] == h][n // 2]
    return [(middle(a, lo_a, hi_a, ca[h]), middle(b, lo_b, hi_b, cb[h]))]


def patience_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines ``(i, j)`` of two line lists by patience diff: equal ends, then unique common lines, again in every gap.

    A gap without such a line is split at its rarest common line, at the middle occurrence in each.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a >= hi_a or lo_b >= hi_b:
            continue
        chain = _anchors(a, b, lo_a, hi_a, lo_b, hi_b)
        if not chain:
            chain = _rarest(a, b, lo_a, hi_a, lo_b, hi_b)
        if not chain:
            continue
        i, j = lo_a, lo_b
        for x, y in [*chain, (hi_a, hi_b)]:
            todo.append((i, x, j, y))
            if x < hi_a:
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


def blocks(matches: list[tuple[int, int]], words: list[int], min_words: int) -> list[int]:
    """Lines of the first document in runs of aligned lines, consecutive in both, that hold at least ``min_words`` words."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*matches, (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= min_words:
                out += run
            run = []
        run.append(i)
        last = (i, j)
    return out


def short_runs(hashes: list[np.ndarray], words: list[np.ndarray], min_words: int) -> tuple[np.ndarray, ...]:
    """``doc, lo, hi, h``: of each document the shortest runs ``lo`` to ``hi - 1`` from each line on and up to each line, with their hash."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    h = np.concatenate([*hashes, np.empty(0, np.int64)]).astype(np.int64).view(np.uint64)
    counts = np.concatenate([*words, np.empty(0, np.int64)]).astype(np.int64)
    at, ends = np.arange(len(h)), np.repeat(np.cumsum(sizes), sizes)
    begins = ends - np.repeat(sizes, sizes)
    before = np.r_[0, np.cumsum(counts)]
    stop = np.searchsorted(before, before[:-1] + min_words)
    start = np.searchsorted(before, before[1:] - min_words, side="right") - 1
    forward = stop <= ends
    backward = (start >= begins) & (stop[np.maximum(start, 0)] != at + 1)  # others are forward runs already
    lo, hi = np.r_[at[forward], start[backward]], np.r_[stop[forward], at[backward] + 1]
    # a polynomial in an odd base modulo 2 ** 64, shifted so that it doesn't depend on the place
    powers, shifts = [np.cumprod(np.r_[np.uint64(1), np.full(len(h), x, np.uint64)], dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
    sums = np.r_[np.uint64(0), np.cumsum(h * powers[:-1], dtype=np.uint64)]
    doc = np.repeat(np.arange(len(sizes)), sizes)[lo]
    return doc, lo - begins[lo], hi - begins[lo], ((sums[hi] - sums[lo]) * shifts[lo]).view(np.int64)


def aligned_lines(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, min_words: int) -> np.ndarray:
    """Lines of ``a`` (line hashes, ``wa`` their words) in blocks that alignments with ``b`` have in common.

    The first alignment is free; then one goes through each shared short run that is not wholly in a block yet.
    """
    if len(a) == len(b) and (a == b).all():
        return np.arange(len(a) if wa.sum() >= min_words else 0)
    gone = np.zeros(len(a), bool)
    x, y, words = a.tolist(), b.tolist(), wa.tolist()
    gone[blocks(patience_matches(x, y), words, min_words)] = True
    doc, lo, hi, h = short_runs([a, b], [wa, wb], min_words)
    there = {key: (begin, end) for key, begin, end in zip(h[doc == 1].tolist(), lo[doc == 1].tolist(), hi[doc == 1].tolist(), strict=True)}
    for key, i, end in zip(h[doc == 0].tolist(), lo[doc == 0].tolist(), hi[doc == 0].tolist(), strict=True):
        if key in there and not gone[i:end].all():
            j, stop = there[key]
            if x[i:end] == y[j:stop]:
                before = patience_matches(x[:i], y[:j])
                after = patience_matches(x[end:], y[stop:])
                path = [*before, *zip(range(i, end), range(j, stop), strict=True), *[(p + end, q + stop) for p, q in after]]
                gone[blocks(path, words, min_words)] = True
    return np.flatnonzero(gone)


def find_repeated_lines(docs: DataFrame, space: Workspace, min_words: int = 5, fan: int = 256) -> DataFrame:
    """``doc_id, whole, gone``: the sorted numbers (from 0) of the lines to delete of each text that loses some.

    ``whole`` is the text's MD5, so rows with one doc_id and different texts are told apart. A document that more than
    ``fan`` others are aligned with is dealt out in copies.
    """
    lines = F.split("text", "\n")
    narrow = space.keep(
        docs.where("doc_id is not null and text is not null and text <> ''").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_key().alias("whole"),
            F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
            F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
        ),
        "lines",
    )
    first = space.keep(narrow.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("latest")).where("latest > first").select("whole", "first"), "copied")
    copies = narrow.select("doc_id", "whole", F.size("hashes").alias("n")).join(first, "whole").where("doc_id > first").select("doc_id", "whole", F.sequence(F.lit(0), F.col("n") - 1).alias("gone")).distinct()
    # one row for each text, that of its earliest document
    texts = space.keep(narrow.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.first("hashes").alias("hashes"), F.first("words").alias("words")), "texts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                b = batch.iloc[k : k + 500]
                doc, lo, hi, h = short_runs(b["hashes"].tolist(), b["words"].tolist(), min_words)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc], "whole": b["whole"].to_numpy()[doc], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "h": h})

    runs = space.keep(texts.mapInPandas(cut, "doc_id long, whole binary, lo int, hi int, h long"), "runs")
    holders = runs.groupBy("h").agg(F.min(F.struct("doc_id", "whole", "lo")).alias("first"), F.max("doc_id").alias("latest")).where("latest > first.doc_id")
    holders = space.keep(holders.select("h", F.col("first.doc_id").alias("other_id"), F.col("first.whole").alias("other"), F.col("first.lo").alias("at")), "holders")
    met = runs.join(holders, "h").where("doc_id > other_id")
    span = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("at").alias("other_lo"), F.max(F.col("at") + F.col("hi") - F.col("lo")).alias("other_hi")]
    pairs = space.keep(met.groupBy("doc_id", "whole", "other").agg(*span), "pairs")
    space.drop("runs")

    salts = pairs.groupBy("other").agg(F.ceil(F.count("*") / fan).cast("int").alias("salts"))
    others = texts.select(F.col("whole").alias("other"), "hashes", "words").join(salts, "other").select("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hashes").alias("other_hashes"), F.col("words").alias("other_words"), "salts")
    part = lambda c, lo, hi: F.slice(c, F.col(lo) + 1, F.col(hi) - F.col(lo)).alias(c)
    own = pairs.join(texts.select("whole", "hashes", "words"), "whole").select("doc_id", "whole", "other", "lo", part("hashes", "lo", "hi"), part("words", "lo", "hi"), "other_lo", "other_hi")
    dealt = own.join(salts, "other").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    both = dealt.join(others.drop("salts"), ["other", "salt"]).select("doc_id", "whole", "lo", "hashes", "words", part("other_hashes", "other_lo", "other_hi"), part("other_words", "other_lo", "other_hi"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x + aligned_lines(*rest, min_words) for x, *rest in zip(b["lo"], b["hashes"], b["words"], b["other_hashes"], b["other_words"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "whole": b["whole"], "gone": found})

    found = copies.union(both.mapInPandas(align, "doc_id long, whole binary, gone array<int>"))
    return found.groupBy("doc_id", "whole").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def text_key() -> Column:
    return F.unhex(F.md5("text"))


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """The documents without repeated lines, with ``n_lines``, ``n_removed`` and ``removed_words``.

    All rows stay; a later whole copy keeps an empty text. A null or empty text has no line and stays as it is, and so
    does a row without doc_id. Line ends are ``\n``. Rows with one doc_id are versions of one document: they don't
    delete from each other, and each loses what an earlier document has. Alike rows stay alike. Texts of any
    length are taken whole. Input columns called like the new ones are replaced; other names may clash with nothing.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lines")
    gone = space.keep(find_repeated_lines(docs, space, min_words), "gone")
    for table in ("lines", "copied", "texts", "holders", "pairs"):
        space.drop(table)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "removed_words")]
    key, drop, before = (fresh(docs, c) for c in ("key", "drop", "before"))
    lost = gone.select(F.struct("doc_id", "whole").alias(key), F.col("gone").alias(drop))
    lines = F.split("text", "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda k: F.get(lines, k)), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(left)
    joined = docs.select(*kept, F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("whole")).alias(key)).join(lost.hint("shuffle_hash"), key, "left")
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(lines))
    words = F.regexp_count("text", F.lit(WORD))
    out = joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in kept], n.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"), words.alias(before))
    return out.withColumn("removed_words", F.when(F.col("n_removed") > 0, F.col(before) - words).otherwise(0).cast("long")).drop(before)
