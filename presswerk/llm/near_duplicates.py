"""Problem 3: groups of rows that tell the same text, by a byte-position inverted index with count filtering.

Each text is a set of word triples; a signature of bytes, one for each of ``BYTES`` random orders of the triples, agrees
at a position with the chance that two sets are similar. The index lists texts by position and the ``GRAM`` bytes from
there. Texts that meet in a list are tallied over positional bytes; pairs with the least number of equal bytes that
similar texts all but surely reach go on, and are verified on their exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.llm.boilerplate import main_text
from presswerk.operators.graph import components, pairs_sharing_keys
from presswerk.llm.repeated_lines import repeated_templates, template_hash
from presswerk.llm.residue import residue_rows
from presswerk.llm.text import WORD
from presswerk.session import stage

SHINGLE = 3
SIMILAR = 0.5
BYTES, GRAM = 256, 4
SKETCH = 32  # positional bytes tallied for each candidate pair
# A pair at SIMILAR agrees in each byte with probability 1/2: 8 of 32 are missed once in 400 such pairs.
LEAST_EQUAL = 8
_MOST_WORDS = 1_000_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 2**32, BYTES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, BYTES, dtype=np.uint64).astype(np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_words: dict[str, int] = {}


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the runs of ``width`` words (letters and digits, case ignored)."""
    found = WORD.findall(text.lower())
    n = len(found) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > _MOST_WORDS:
        _words.clear()
    numbers = np.empty(len(found), dtype=np.uint64)
    for i, w in enumerate(found):
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        numbers[i] = h
    total = numbers[:n] * _MIX[0]
    for k in range(1, width):
        total = (total ^ (total >> np.uint64(29))) * _MIX[4] + numbers[k : k + n] * _MIX[k % 4]
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(items: np.ndarray) -> np.ndarray:
    """One byte for each of BYTES random orders of the items: the low byte of the least one."""
    low = (items >> np.uint64(17)).astype(np.uint32)
    if len(low) <= 4096:
        return (low[:, None] * _MULTIPLY + _ADD).min(axis=0).astype(np.uint8)
    least = np.full(BYTES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 4096):  # long texts in blocks, so that memory doesn't follow their length
        least = np.minimum(least, (low[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return least.astype(np.uint8)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0), type=kind))


def _texts(batch: pa.RecordBatch, sets: dict) -> Iterator[tuple[int, str]]:
    """Row id and the compared text of each row: title, summary and main text joined."""
    c = batch.to_pydict()
    for row, source, title, summary, text, templates in zip(c["row_id"], c["source"], c["title"], c["summary"], c["extracted_text"], c["templates"], strict=True):
        if source not in sets:
            sets[source] = frozenset(templates or ())
        body = main_text(text, title, None, sets[source], template_hash) if text else ""
        yield row, f"{title or ''}\n{summary or ''}\n{body}"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict = {}
    for batch in batches:
        ids, kinds, sizes, sketches, grams = [], [], [], [], []
        for row, text in _texts(batch, sets):
            items = shingles(text)
            if len(items):
                sig = signature(items)
                ids.append(row)
                kinds.append(xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63))
                sizes.append(len(items))
                sketches.append(sig[:SKETCH].view(np.int64))
                grams.append(sig.view(np.int32))
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(kinds, pa.int64()), pa.array(sizes, pa.int32()), _lists(sketches, pa.int64()), _lists(grams, pa.int32())],
            names=["row_id", "kind", "size", "sketch", "grams"],
        )


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict = {}
    for batch in batches:
        got = [(row, shingles(text).view(np.int64)) for row, text in _texts(batch, sets)]
        yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), _lists([g[1] for g in got], pa.int64())], names=["row_id", "items"])


def _equal_bytes(one: str, other: str) -> F.Column:
    """How many of the SKETCH positional bytes of two columns agree."""
    total = F.lit(0)
    for i in range(SKETCH // 8):
        x = F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        for k in range(8):
            total = total + F.when(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return total


def compared_rows(articles: DataFrame) -> DataFrame:
    """The rows of news (problem 7 left out), each with its source's excessive lines (problem 6)."""
    rows = articles.where(F.col("row_id").isNotNull()).select("row_id", F.coalesce("source", F.lit("")).alias("source"), "title", "summary", "extracted_text")
    return rows.join(residue_rows(articles), "row_id", "left_anti").join(repeated_templates(articles), "source", "left")


def near_duplicates(articles: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``members(row_id, class)`` of all compared rows, and ``links(a, b)`` between similar classes.

    A class holds the rows with exactly the same triples and is named by its least row id; a link joins two classes of
    which shared triples are at least ``similar`` of all triples of both. Needs ``row_id, source, title, summary,
    extracted_text``; nulls are empty texts, a text of fewer than three words has no triples and is left out, repeated
    rows fall into one class, rows without an id are left out. Copies are never paired with each other, whatever their number.
    """
    rows = compared_rows(articles)
    signed = stage(rows.mapInArrow(_sign, "row_id bigint, kind bigint, size int, sketch array<bigint>, grams array<int>"), "signatures")
    classes = signed.groupBy("kind").agg(F.min_by(F.struct("row_id", "size", "sketch", "grams"), "row_id").alias("first"))
    classes = stage(classes.select("kind", "first.*"), "classes")
    members = signed.select("row_id", "kind").join(classes.select("kind", F.col("row_id").alias("class")), "kind").select("row_id", "class")
    postings = classes.select(F.col("row_id").alias("id"), F.posexplode("grams").alias("at", "gram"))
    postings = postings.select((F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("gram").cast("bigint")).alias("key"), "id")
    met = pairs_sharing_keys(postings).select("a", "b")
    small = classes.select("row_id", "size", "sketch")
    tallied = (
        met.join(small.select(F.col("row_id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(small.select(F.col("row_id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb")), "b")
        # sets of too different sizes can't be similar enough
        .where((F.least("na", "nb") >= F.greatest("na", "nb") * similar) & (_equal_bytes("sa", "sb") >= LEAST_EQUAL))
        .select("a", "b")
    )
    tallied = stage(tallied, "tallied")
    wanted = tallied.select(F.col("a").alias("row_id")).unionByName(tallied.select(F.col("b").alias("row_id"))).distinct()
    items = stage(rows.join(wanted, "row_id", "left_semi").mapInArrow(_items, "row_id bigint, items array<bigint>"), "items")
    # a repeated row id (a redelivered row) would double its pairs
    items = items.groupBy("row_id").agg(F.first("items").alias("items"))
    common = F.size(F.array_intersect("ia", "ib"))
    links = (
        tallied.join(items.select(F.col("row_id").alias("a"), F.col("items").alias("ia")), "a")
        .join(items.select(F.col("row_id").alias("b"), F.col("items").alias("ib")), "b")
        .where(common >= similar * (F.size("ia") + F.size("ib") - common))
        .select("a", "b")
    )
    return members, stage(links, "similar")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of rows of linked or equal classes, each once; its size is the size of the groups squared."""
    ma = members.select(F.col("row_id").alias("ra"), F.col("class").alias("a"))
    mb = members.select(F.col("row_id").alias("rb"), F.col("class").alias("b"))
    across = links.join(ma, "a").join(mb, "b")
    within = ma.join(mb, ma["a"] == mb["b"]).where(F.col("ra") < F.col("rb"))
    both = across.select("ra", "rb").unionByName(within.select("ra", "rb"))
    return both.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))


def near_duplicate_groups(articles: DataFrame) -> DataFrame:
    """``(row_id, group_id, links)``: one row per compared row, its group's least row id and its class's links."""
    members, links = near_duplicates(articles)
    members = stage(members, "members")
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = members.join(roots.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
    return named.select("row_id", F.coalesce("root", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
