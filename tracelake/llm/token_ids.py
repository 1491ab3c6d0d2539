"""Token ids of whole texts, looked up piece by piece.

For tokenizers that drop white space and never join over it. A batch's words are split and numbered by Arrow; where the
tokenizer cuts words by a pattern that is known here, each distinct word is cut likewise, so that far fewer pieces than
words have to be known. Each distinct piece is looked up once, and only pieces not met before are tokenized, many in one
call.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBER = 1_000_000      # pieces whose ids a worker keeps, some 200 MB
TOGETHER = 500
MARK = "\x01"             # a word of its own between pieces that are tokenized together

# The pattern of a tokenizer's pieces, and the same for words of ASCII and Western letters in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "^[\x01-\x7fÀ-ÖØ-öø-ÿ]*$"
PLAIN_PATTERN = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


def runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) + total < 1 << 31) else np.int64
    place = np.repeat((starts - ends + lens).astype(small), lens)
    place += np.arange(total, dtype=small)
    return place


class TokenIds:
    def __init__(self, tokenizer: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.model.no_truncation()
        self.model.no_padding()
        self.size = self.model.get_vocab_size()
        self.mark = self.ids_of(MARK)
        told = json.loads(self.model.to_str())
        steps = told["pre_tokenizer"].get("pretokenizers", []) if told.get("pre_tokenizer") else []
        self.cuts = any(x.get("pattern") == {"Regex": PATTERN} and x.get("behavior") == "Removed" for x in steps)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.forget()

    def ids_of(self, word: str) -> list[int]:
        return self.model.encode_batch_fast([word], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.lens[0] = 1

    def keep(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.rows) + 1
        while n + len(words) > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        end = self.used + int(lens.sum())
        while end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:end] = ids
        self.starts[n:n + len(words)] = self.used + np.cumsum(lens) - lens
        self.lens[n:n + len(words)] = lens
        self.rows.update(zip(words, range(n, n + len(words))))
        self.used = end

    def learn(self, words: list[str]) -> None:
        """Tokenize new words; those that hold the mark, or come out in other pieces than expected, one by one."""
        plain = [w for w in words if MARK not in w]
        alone = [w for w in words if MARK in w]
        if len(self.mark) == 1:
            groups = [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
            for at in range(0, len(groups), 20):
                some = groups[at:at + 20]
                joined = self.model.encode_batch_fast([f" {MARK} ".join(g) for g in some], add_special_tokens=False)
                for group, got in zip(some, joined):
                    ids = np.array(got.ids, np.uint32)
                    cuts = np.flatnonzero(ids == self.mark[0])
                    if len(cuts) == len(group) - 1:
                        self.keep(group, np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                    else:
                        alone += group
        else:
            alone = words
        for at in range(0, len(alone), 10_000):
            some = alone[at:at + 10_000]
            ids = [e.ids for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
            self.keep(some, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))

    def pieces(self, words: pa.StringArray) -> pa.ListArray:
        """The pieces of words; a word that may be cut otherwise is one piece."""
        if not self.cuts:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1), pa.int32()), words)
        plain = pc.match_substring_regex(words, PLAIN)
        for sign in (MARK, *self.special):
            plain = pc.and_not(plain, pc.match_substring(words, sign))
        cut = pc.replace_substring_regex(pc.utf8_lower(words), PLAIN_PATTERN, "\\1 ")
        return pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_rtrim(cut, " "), words))

    def rows_of(self, pieces: pa.StringArray) -> np.ndarray:
        """Rows of distinct pieces, learnt where they are new."""
        met = pieces.to_pylist()
        if len(self.rows) + len(met) > REMEMBER:
            self.forget()
        if new := [w for w in met if w not in self.rows]:
            self.learn(new)
        return np.fromiter(map(self.rows.__getitem__, met), np.int64, len(met))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and where each text ends in them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        cut = self.pieces(words.dictionary)
        pieces = cut.flatten().dictionary_encode()
        row = self.rows_of(pieces.dictionary)[pieces.indices.to_numpy(zero_copy_only=False)]
        # Ids of each distinct word, one after the other; the end of a text is one more word, whose only id is the first.
        n_pieces = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.concatenate([[end_id], self.flat.take(runs(self.starts[row], self.lens[row]))]).astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(self.lens[row])])
        word_end = np.cumsum(n_pieces)
        word_lens = upto[word_end] - upto[word_end - n_pieces]
        starts, lens = np.concatenate([[0], 1 + upto[word_end - n_pieces]]), np.concatenate([[1], word_lens])

        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
        inside = np.ones(len(words) + len(last), bool)
        inside[last] = False
        at = np.zeros(len(inside), np.int32)
        at[inside] = words.indices.to_numpy(zero_copy_only=False) + 1
        lens = lens[at]
        return ids.take(runs(starts[at], lens)), np.cumsum(lens)[last]


@lru_cache(maxsize=1)
def token_ids(tokenizer: str) -> TokenIds:
    return TokenIds(tokenizer)
