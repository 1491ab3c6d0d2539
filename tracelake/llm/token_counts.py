"""Token counts by byte-pair merging with a heap and a linked list.

A text's symbols start as its characters. The adjacent pair whose merged piece has the best rank is merged again and
again, the leftmost first among equals; the number of tokens is the number of initial symbols less the merges, where a
character outside the vocabulary counts its UTF-8 bytes. No identifiers are made.

Null and empty texts have no tokens. Rows that repeat are counted each; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import per_batch, utf8, values

SPACE = "▁"  # fixed value: the sign that pieces have for a blank
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeCounter(dict):
    """Tokens of a chunk, remembered for up to ``remember`` chunks (some 200 MB)."""

    def __init__(self, ranks: dict[str, int], remember: int = 1_000_000):
        super().__init__()
        self.ranks, self.remember = ranks, remember
        self.single = {p for p in ranks if len(p) == 1}
        inside = any(SPACE in p.lstrip(SPACE) for p in ranks)
        self.lone = "\n" if not any("\n" in p for p in ranks) else ""
        # No piece goes on past the end of a word, so words are merged one by one; otherwise texts are merged whole.
        self.chunks = None if inside else re.compile(f"{SPACE}+[^{SPACE}{self.lone}]*|[^{SPACE}{self.lone}]+")

    def __missing__(self, chunk: str) -> int:
        n = self.merged(chunk)
        if len(self) >= self.remember:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def merged(self, chunk: str) -> int:
        rank, n = self.ranks.get, len(chunk)
        piece = [*chunk, ""]  # a symbol merged into the one on its left becomes empty
        tokens = sum([1 if c in self.single else len(c.encode()) for c in chunk])
        # A pair is its rank and the place of its left symbol, in one number.
        heap = [r << 32 | i for i, r in enumerate(map(rank, map(str.__add__, chunk, chunk[1:]))) if r is not None]
        if not heap:
            return tokens
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            left, right = piece[i], piece[j]
            if not left or not right or rank(both := left + right) != entry >> 32:
                continue  # one of the two has been merged meanwhile
            piece[i], piece[j] = both, ""
            tokens -= 1
            after[i] = k = after[j]
            before[k] = i
            if (more := piece[k]) and (r := rank(both + more)) is not None:
                heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(piece[h] + both)) is not None:
                heappush(heap, r << 32 | h)
        return tokens

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.chunks is None:
            return self.merged(text)
        lone = text.count(self.lone) if self.lone else 0
        return lone + sum(map(self.__getitem__, self.chunks.findall(text)))


@lru_cache(maxsize=2)
def counter(model: str) -> MergeCounter:
    """The ranks of a vocabulary file, read once in each worker."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return MergeCounter({sp.id_to_piece(i): round(-sp.get_score(i)) for i in plain})


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every row, and whether it has more tokens than ``limit``."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, of = values(batch, "text"), counter(model)
        tokens = np.array([of.count(t.decode()) for t in texts], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")), count, SCHEMA)
