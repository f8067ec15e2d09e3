"""Problem 8: byte-level BPE of a whole corpus in batched numpy merge rounds.

The words of a batch lie in one flat array of symbols. Each round looks all adjacent pairs up by binary search in the
sorted table of pair keys, takes each word's pair of lowest rank, merges its places in every word at once and drops the
words that have none left. A word is encoded once in the life of a worker (the cache is bounded).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from presswerk.session import spread

# Fixed value: how this family of tokenizers splits text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(2**62)
MOST_CACHED = 400_000
LONGEST_CACHED = 64


@dataclass
class PairTable:
    """The vocabulary as arrays: symbols of single bytes, sorted pair keys and what each pair becomes (its rank)."""

    bytes_to_symbol: np.ndarray
    keys: np.ndarray
    merged: np.ndarray


def default_ranks_path() -> str:
    """The ranks file of byte_bpe_50k, from the public tokenizer files of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> PairTable:
    """The table of a ranks file (base64 token, rank, one a line). Every split of a token into two tokens is a pair."""
    ranks: dict[bytes, int] = {}
    with open(os.fspath(path), "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    keys, merged = [], []
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                keys.append((left << 32) | right)
                merged.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64))
    singles = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    return PairTable(singles, np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order])


def merge_words(words: list[bytes], table: PairTable) -> list[np.ndarray]:
    """The symbols of each word after all merges."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    symbols = table.bytes_to_symbol[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    while len(symbols):
        inside = owner[:-1] == owner[1:]
        key = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
        rank = np.where(inside & (table.keys[at] == key), table.merged[at], NO_RANK)
        rank = np.append(rank, NO_RANK)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(owner)))
        done = least == NO_RANK
        if done.any():
            for s, n in zip(starts[done], sizes[done], strict=True):
                out[owner[s]] = symbols[s : s + n].astype(np.int32)
            keep = np.repeat(~done, sizes)
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            least, sizes = least[~done], sizes[~done]
            if not len(symbols):
                break
        chosen = rank == np.repeat(least, sizes)
        # of overlapping places (aaa) every second one merges, from the left of each run
        index = np.arange(len(chosen))
        run_start = chosen & ~np.append(False, chosen[:-1])
        since = index - np.maximum.accumulate(np.where(run_start, index, 0))
        chosen &= since % 2 == 0
        symbols = np.where(chosen, rank, symbols)
        gone = np.append(False, chosen[:-1])
        symbols, owner = symbols[~gone], owner[~gone]
    return out


class Encoder:
    """Texts to ids, with the words met so far as one growing flat table."""

    def __init__(self, table: PairTable) -> None:
        self.table = table
        self.split = regex.compile(WORDS).findall
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.start = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)

    def _learn(self, fresh: list[str]) -> None:
        merged = merge_words([w.encode("utf-8", "replace") for w in fresh], self.table)
        size = np.array([len(m) for m in merged], dtype=np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        for i, w in enumerate(fresh, len(self.start)):
            self.number[w] = i
        self.ids = np.concatenate([self.ids, *merged])
        self.start = np.concatenate([self.start, first])
        self.length = np.concatenate([self.length, size])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)``: the ids of all texts in one array; an empty or null text has none."""
        if len(self.number) > MOST_CACHED or len(self.ids) > 16 * MOST_CACHED:
            self._reset()
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                words += self.split(text)
            ends[i + 1] = len(words)
        fresh = set(words).difference(self.number)
        if fresh:
            self._learn(list(fresh))
        at = np.fromiter((self.number[w] for w in words), dtype=np.int64, count=len(words))
        size = self.length[at]
        total = np.append(0, np.cumsum(size))
        flat = self.ids[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        for w in fresh:
            if len(w) > LONGEST_CACHED:  # its ids stay in the table until the next reset, but it isn't looked up again
                del self.number[w]
        return total[ends], flat


def _chunks(texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch whose texts together stay near ``most_chars`` (one longer text is a slice of its own)."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most_chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_documents(documents: DataFrame, ranks_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)``: each document's ids, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts have an empty list; every row has one
    row, repeated rows as well; a null key stays null. The vocabulary is broadcast: its file has a fixed size.
    """
    table = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path or default_ranks_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, stop in _chunks(texts):
                offsets, ids = encoder.encode(texts[at:stop])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(at, stop - at), lists], names=[key, "ids"])

    return spread(documents.select(key, text)).mapInArrow(run, f"{key} bigint, ids array<int>")
