"""SentencePiece encoding and decoding through a merge-type prefix table.

For every prefix of a word the table holds the one token that ends the prefix's encoding: of the vocabulary
entries that end there (an automaton reports them) it is the one that starts the word or may follow the last
token of the shorter prefix, which a pair-compatibility test decides. The ids are then read backwards.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.worker_memory import held
from tidegraph.llm.workspace import fresh

SPACE = "▁"
#: Words longer than this are encoded without being remembered.
CACHED_CHARS = 48
#: Words, and pairs of tokens, that a worker remembers; those beyond are worked out again.
CACHED_WORDS, CACHED_PAIRS = 400_000, 400_000
#: Documents that leave a worker at once.
BLOCK = 500


class Words(dict):
    """Words to their ids as 32-bit integers; up to ``most`` are remembered."""

    def __init__(self, codec: PieceCodec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, word: str) -> bytes:
        found = array("i", self.codec.encode_word(word)).tobytes()
        if len(word) <= CACHED_CHARS and len(self) < self.most:
            self[word] = found
        return found


class PieceCodec:
    """Encoder and decoder for a byte-fallback BPE model whose normaliser is the identity with a dummy prefix."""

    def __init__(self, model_file: str, words: int = CACHED_WORDS, pairs: int = CACHED_PAIRS):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.plain: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.plain[piece] = i
        self.scores = {piece: model.get_score(i) for piece, i in self.plain.items()}
        self.bytes_of: list[bytes] = [b""] * size
        for piece, i in self.plain.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([byte])
        if any(SPACE in piece.lstrip(SPACE) for piece in self.plain):
            raise ValueError("a piece holds a space after another character; words can't be encoded apart")
        chars = {c for piece in self.plain for c in piece}
        if not chars <= self.plain.keys():
            raise ValueError("a piece holds a character that is no piece")
        self.chars = frozenset(chars)
        #: a word starts with spaces or after a character outside the vocabulary
        self.words = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        self.most_pairs = pairs
        self.known = Words(self, words)
        self.numerals = [str(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.plain.items():
            if self._merge(piece) == [piece]:  # a piece that merging can't reach never ends an encoding
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def _merge(self, text: str) -> list[str]:
        """Repeatedly joins the adjacent pair of best score, leftmost first; only for pieces and pairs of pieces."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joined text."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self._merge(a + b) == [a, b]
            if len(self.pairs) < self.most_pairs:
                self.pairs[key] = known
        return known

    def _span(self, text: str) -> list[int]:
        """Ids of a run of characters that are all in the vocabulary."""
        last: list = [None] * len(text)
        pairs, fits = self.pairs, self._fits
        for end, (token, size) in self.automaton.iter(text):
            if last[end] is None:
                before = end - size
                if before >= 0:
                    left = last[before][0]
                    fit = pairs.get(left << 20 | token)
                    if not (fits(left, token) if fit is None else fit):
                        continue
                last[end] = (token, size)
        ids, end = [], len(text) - 1
        while end >= 0:
            token, size = last[end]
            ids.append(token)
            end -= size
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        if self.chars.issuperset(word):
            return self._span(word)
        plain, ids, start = self.plain, [], 0
        for k, c in enumerate(word):
            if c not in plain:
                if start < k:
                    ids += self._span(word[start:k])
                ids += [self.byte_ids[b] for b in c.encode()]
                start = k + 1
        if start < len(word):
            ids += self._span(word[start:])
        return ids

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def ids(self, text: str) -> np.ndarray:
        """The ids, by way of the remembered words."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in self.encode_word(word)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the dummy space goes, byte pieces join to characters, broken bytes read as U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        if ids and self.pieces[ids[0]].startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        ids = self.ids(text).tolist()
        joined = ",".join(map(self.numerals.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def codec(model_file: str, words: int, pairs: int) -> PieceCodec:
    """The codec of a model file that this worker process keeps."""
    return held(("pieces", model_file, words, pairs), lambda: PieceCodec(model_file, words, pairs))


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", decoded_sha256: str | None = None, remembered: tuple[int, int] = (CACHED_WORDS, CACHED_PAIRS)) -> DataFrame:
    """Adds the ids and, where ``decoded`` and ``decoded_sha256`` name columns, the decoded text of every whole text and its SHA-256.

    A null text counts as empty: no ids, empty text. Whole texts of any length; repeated rows stay. ``model_file`` must be readable under that name on every
    executor. Input columns called like the new ones are replaced. ``remembered`` bounds the words and pairs of tokens that
    a worker keeps, which changes its memory and speed only.
    """
    whole = fresh(docs, "whole_text")
    added = {n: kind for n, kind in ((ids, "array<int>"), (decoded, "string"), (decoded_sha256, "string")) if n}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_file, *remembered)
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.iloc[k : k + BLOCK]
                new: dict[str, list] = {n: [] for n in added}
                for t in part[whole]:
                    found = own.ids(t or "")
                    new[ids].append(found)
                    back = own.decode(found.tolist()) if len(added) > 1 else ""
                    if decoded:
                        new[decoded].append(back)
                    if decoded_sha256:
                        new[decoded_sha256].append(hashlib.sha256(back.encode()).hexdigest())
                yield part.drop(columns=whole).assign(**new)

    kept = [c for c in docs.columns if c.lower() not in [n.lower() for n in added]]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema] + [f"`{n}` {kind}" for n, kind in added.items()])
    return docs.select(*kept, F.col(text).alias(whole)).mapInPandas(run, fields)


def encode_digests(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; as ``encode_texts``, but no list of ids leaves a task.

    A null text counts as empty, whose digests are those of no bytes. Texts are encoded whole, however long; rows that
    repeat a doc_id, or have none, are rows like others. Other columns are not read, so their names clash with nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_file, CACHED_WORDS, CACHED_PAIRS)
        for batch in batches:
            rows = [own.digest(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
