"""Problem 9: passages of held-out items inside the corpus, through suffix arrays of the corpus.

The words of a shard of documents (letters and digits, case ignored, markup and line breaks gone) are numbered by the
vocabulary of the items and their suffixes sorted. Every suffix of every item is then looked up in every shard by binary
search; its neighbours give the longest verbatim match and the documents and places that hold it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.llm.text import WORD
from presswerk.session import spread

LEAST_WORDS = 12
DEPTH = 16  # suffixes are sorted by so many words; matches beyond are walked
SHARD_WORDS = 400_000
BLOCK_WORDS = 2_000_000  # items are searched in blocks of so many words

_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[!/]?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
SCHEMA = "doc_id bigint, item_id bigint, words int, doc_at int, item_at int"


def bare_words(text: str | None) -> list[str]:
    """The words of a text; inline markup vanishes, other tags part words, entities and composed letters are resolved."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return WORD.findall(unicodedata.normalize("NFC", _INVISIBLE.sub("", text)).lower())


def suffix_array(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The places of ``words`` in the order of their next ``depth`` words, by doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    reach = 1
    while reach < depth:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:]
        rank = np.unique((rank << 32) | after, return_inverse=True)[1].astype(np.int64) + 1
        reach *= 2
    return np.argsort(rank, kind="stable")


class Items:
    """The items' words in one array, each item ended by a number that no text has."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int) -> None:
        split = [bare_words(t) for t in texts]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
        flat, owner, place, left = [], [], [], []
        for item, ws in zip(ids, split, strict=True):
            flat += [self.number[w] for w in ws] + [-2]
            owner += [item] * (len(ws) + 1)
            place += range(len(ws) + 1)
            left += range(len(ws), -1, -1)
        self.words = np.array(flat + [-2] * DEPTH, dtype=np.int64)
        self.owner, self.place = np.array(owner, dtype=np.int64), np.array(place, dtype=np.int32)
        self.starts = np.flatnonzero(np.array(left) >= least)


def _compare(text: np.ndarray, at: np.ndarray, items: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign of text suffix against item suffix over ``depth`` words, and the words they share."""
    sign, same = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for k in range(depth):
        diff = text[at + k] - items[start + k]
        open_ = sign == 0
        same += open_ & (diff == 0)
        sign = np.where(open_, np.sign(diff), sign)
        if sign.all():
            break
    return sign, same


def search_shard(doc_ids: list[int], words: list[np.ndarray], items: Items, least: int) -> pd.DataFrame:
    """All matches of at least ``least`` words between the items and the documents of one shard, one for each
    document, item and place, as long as they go."""
    ends = np.cumsum([len(w) + 1 for w in words])
    text = np.concatenate([np.append(w, -1) for w in words] + [np.full(DEPTH, -1)])
    order = suffix_array(text)[DEPTH:] if len(text) > DEPTH else np.empty(0, dtype=np.int64)
    order = order[order < ends[-1]] if len(order) else order
    starts = items.starts
    empty = pd.DataFrame({"doc_id": [], "item_id": [], "words": [], "doc_at": [], "item_at": []}).astype("int64")
    if not len(order) or not len(starts):
        return empty
    bounds = []
    for strict in (False, True):  # the first suffix that isn't below, and the first that is above, in ``least`` words
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(order), dtype=np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(order) - 1)
            sign, _ = _compare(text, order[middle], items.words, starts, least)
            below = (sign <= 0) if strict else (sign < 0)
            active = low < high
            low = np.where(active & below, middle + 1, low)
            high = np.where(active & ~below, middle, high)
        bounds.append(low)
    size = bounds[1] - bounds[0]
    hit = np.repeat(np.arange(len(starts)), size)
    if not len(hit):
        return empty
    within = np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)
    at, start = order[np.repeat(bounds[0], size) + within], starts[hit]
    # a match that goes on to the left is found from its own beginning
    begins = (at == 0) | (start == 0) | (text[at - 1] != items.words[start - 1])
    at, start = at[begins], start[begins]
    length = np.full(len(at), least, dtype=np.int64)
    going = np.ones(len(at), dtype=bool)
    while going.any():
        a, b = np.minimum(at + length, len(text) - 1), np.minimum(start + length, len(items.words) - 1)
        going &= (text[a] == items.words[b]) & (text[a] > 0)
        length += going
    doc = np.searchsorted(ends, at, side="right")
    first = np.append(0, ends[:-1])[doc]
    return pd.DataFrame(
        {"doc_id": np.array(doc_ids, dtype=np.int64)[doc], "item_id": items.owner[start], "words": length, "doc_at": at - first, "item_at": items.place[start]}
    )


def leaked_passages(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, words, doc_at, item_at)``: every maximal run of at least ``least_words`` words that a
    document shares with an item, with its length and its places (in words, from 0).

    Needs ``doc_id, text`` and ``item_id, text``. Null, empty and short texts and documents without an id match nothing; repeated documents each
    match. Items are a held-out set of given size: they are read to the driver in blocks and each block is broadcast;
    documents are never moved.
    """
    spark = documents.sparkSession
    blocks, size = [([], [])], 0
    for row in items.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id").toLocalIterator():
        if size > BLOCK_WORDS * 6:
            blocks, size = [*blocks, ([], [])], 0
        blocks[-1][0].append(row["item_id"])
        blocks[-1][1].append(row["text"])
        size += len(row["text"])
    found = None
    for ids, texts in blocks:
        shared = spark.sparkContext.broadcast(Items(ids, texts, least_words))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = shared.value
            names: list[int] = []
            parts: list[np.ndarray] = []
            size = 0
            get = held.number.get
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    ws = bare_words(text)
                    if len(ws) < least_words:
                        continue
                    names.append(doc)
                    parts.append(np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)))
                    size += len(ws)
                    if size >= SHARD_WORDS:
                        yield search_shard(names, parts, held, least_words)
                        names, parts, size = [], [], 0
            if names:
                yield search_shard(names, parts, held, least_words)

        part = spread(documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInPandas(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def leaked_documents(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, words)``: the documents to remove, the items that leaked and the longest run of each pair."""
    return leaked_passages(documents, items, least_words).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def without_leaks(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents in which no item leaked, with all their columns."""
    return documents.join(leaked_documents(documents, items, least_words).select("doc_id").distinct(), "doc_id", "left_anti")
