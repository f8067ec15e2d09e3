"""Problem 6: lines that stand in an excessive share of one source's texts.

Each task parses the lines of its rows into templates with a token tree of fixed depth (source, number of tokens, first
token, last token), in which a run of digits is a wildcard slot. A tree holds a count of rows for each template, is
emptied when full, and trees of all tasks are merged by one keyed sum, so that a hot source is added up in its tasks
first. A second pass over the rows looks their lines up among the templates that cover enough rows.

``line_templates`` goes further than lines that are the same: at the leaves of the same tree lines that agree in most
tokens become one template, in which whatever differs (names, places, amounts) is a wildcard slot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.llm.text import line_key
from presswerk.session import spread, stage

FLUSH = 200_000
SLOT = "*"
LEAF = 2_000  # different lines of a leaf that one task merges at once
TREE_SCHEMA = "source string, template bigint, rows bigint"


def template_hash(key: str) -> int:
    """A signed 64-bit number of a template (a line key, whose ``0`` are the slots)."""
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


class TokenTree:
    """source -> (tokens, first token, last token) -> template -> rows."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict[tuple[int, str, str], Counter]] = {}
        self.size = 0

    def add(self, source: str, template: str) -> None:
        tokens = template.split(" ")
        leaf = self.nodes.setdefault(source, {}).setdefault((len(tokens), tokens[0], tokens[-1]), Counter())
        if template not in leaf:
            self.size += 1
        leaf[template] += 1

    def drain(self) -> pd.DataFrame:
        flat = [(s, template_hash(t), n) for s, inner in self.nodes.items() for leaf in inner.values() for t, n in leaf.items()]
        self.nodes, self.size = {}, 0
        return pd.DataFrame(flat, columns=["source", "template", "rows"])


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tree = TokenTree()
    for b in batches:
        for source, text in zip(b["source"], b["extracted_text"], strict=True):
            for key in {line_key(x) for x in text.split("\n")}:
                if key:
                    tree.add(source, key)
            if tree.size >= FLUSH:
                yield tree.drain()
    yield tree.drain()


def repeated_templates(articles: DataFrame, least_rows: int = 5, least_share: float = 0.02) -> DataFrame:
    """``(source, templates)``: the hashes of a source's excessive lines as one array.

    A source has at most ``1 / least_share`` times its mean number of lines of them, so the arrays are bounded whatever
    the number of rows. Rows with a null ``extracted_text`` don't count; a null source is a source of its own.
    """
    rows = articles.where(F.col("extracted_text").isNotNull()).select(F.coalesce("source", F.lit("")).alias("source"), "extracted_text")
    merged = spread(rows).mapInPandas(_grow, TREE_SCHEMA).groupBy("source", "template").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= least_rows)
    totals = rows.groupBy("source").agg(F.count("*").alias("total"))
    over = merged.join(totals, "source").where(F.col("rows") >= F.col("total") * least_share - 1e-9)
    return stage(over.groupBy("source").agg(F.sort_array(F.collect_list("template")).alias("templates")), "templates")


def merged_templates(counted: list[tuple[str, int]], similar: float) -> list[tuple[str, int]]:
    """``(template, rows)`` of one leaf, from its lines or from templates of its parts, the commonest first.

    A line joins the template with which it shares most tokens, if these are at least ``similar`` of all; tokens that
    differ become slots, and a slot agrees with nothing, so a template never dissolves into slots. Ties go to the template that
    came first.
    """
    held: list[list] = []  # tokens, rows
    for line, rows in sorted(counted, key=lambda x: (-x[1], x[0])):
        tokens = line.split(" ")
        shared = [sum(x == y != SLOT for x, y in zip(h[0], tokens, strict=True)) for h in held]
        best = max(range(len(held)), key=lambda i: (shared[i], -i), default=None)
        if best is not None and shared[best] >= similar * len(tokens):
            held[best] = [[x if x == y else SLOT for x, y in zip(held[best][0], tokens, strict=True)], held[best][1] + rows]
        else:
            held.append([tokens, rows])
    return [(" ".join(h[0]), h[1]) for h in held]


def line_templates(articles: DataFrame, similar: float = 0.6, least_rows: int = 5, least_share: float = 0.02) -> DataFrame:
    """``(source, template, rows)``: what lines of a source have in common, ``*`` where they differ, and how often it stands.

    A tree of fixed depth (source, tokens, first token, last token) leads each line to a leaf, where it joins a template
    (see ``merged_templates``). A line counts once in a row; a template counts its lines. Given are templates that stand at
    least ``least_rows`` times and in ``least_share`` of its source's rows. Rows with a null text don't count, a null source is
    a source of its own, blank lines have no template, empty tables give no rows.

    Equal lines are added up before any shuffle and leaves that hold too few lines for a template are left there, so only
    what repeats reaches Python. A leaf of very many different lines is merged in parts first, as trees of their own.
    """
    rows = articles.where(F.col("extracted_text").isNotNull()).select(F.coalesce("source", F.lit("")).alias("source"), "extracted_text")

    def key(x: Column) -> Column:
        return F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), r"(?U)\d+", "0"))

    lines = rows.select("source", F.explode(F.array_distinct(F.transform(F.split("extracted_text", "\n"), key))).alias("line"))
    counts = lines.where("line != ''").groupBy("source", "line").agg(F.count("*").alias("rows"))
    tokens = F.split("line", " ")
    leaf = ["source", "tokens", "first", "last"]
    counts = stage(counts.select("source", F.size(tokens).alias("tokens"), F.get(tokens, F.lit(0)).alias("first"), F.element_at(tokens, -1).alias("last"), "line", "rows"), "lines")
    wide = counts.groupBy(*leaf).agg(F.count("*").alias("n"), F.sum("rows").alias("all")).where(F.col("all") >= least_rows).drop("all")
    parted = counts.join(wide, leaf).withColumn("part", F.pmod(F.xxhash64("line"), F.ceil(F.col("n") / LEAF))).drop("n")
    shape = "source string, tokens int, first string, last string, line string, rows bigint"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = merged_templates(list(zip(pdf["line"], pdf["rows"], strict=True)), similar)
        return pd.DataFrame([(*pdf.loc[0, leaf], t, n) for t, n in got], columns=[*leaf, "line", "rows"])

    merged = parted.groupBy(*leaf, "part").applyInPandas(lambda pdf: merge(pdf.drop(columns="part")), shape)
    merged = merged.groupBy(*leaf, "line").agg(F.sum("rows").alias("rows")).groupBy(*leaf).applyInPandas(merge, shape)
    totals = rows.groupBy("source").agg(F.count("*").alias("total"))
    over = merged.where(F.col("rows") >= least_rows).join(totals, "source").where(F.col("rows") >= F.col("total") * least_share - 1e-9)
    return over.select("source", F.col("line").alias("template"), "rows")


def _look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets: dict[str, frozenset[int]] = {}
    hashes: dict[str, int] = {}
    for b in batches:
        ids, numbers = [], []
        for row, source, text, templates in zip(b["row_id"], b["source"], b["extracted_text"], b["templates"], strict=True):
            if source not in sets:
                sets[source] = frozenset(templates.tolist())
            over = sets[source]
            for n, line in enumerate(text.split("\n"), 1):
                key = line_key(line)
                if key:
                    h = hashes.get(key)
                    if h is None:
                        h = template_hash(key)
                        if len(hashes) < FLUSH:
                            hashes[key] = h
                    if h in over:
                        ids.append(row)
                        numbers.append(n)
        yield pd.DataFrame({"row_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int64")})


def repeated_lines(articles: DataFrame, least_rows: int = 5, least_share: float = 0.02) -> DataFrame:
    """``(row_id, line_no)`` of the lines that stand in at least ``least_rows`` rows and ``least_share`` of a source.

    Lines are the same when they agree after trimming, with white space folded, digit runs as one ``0``, in lower
    case; they are counted from 1 with blank lines, which are never given. A line twice in one row counts that row
    once and is given twice; a row without an id counts and gives none. Empty tables give no rows.
    """
    over = repeated_templates(articles, least_rows, least_share)
    rows = articles.where(F.col("extracted_text").isNotNull() & F.col("row_id").isNotNull()).select("row_id", F.coalesce("source", F.lit("")).alias("source"), "extracted_text")
    return spread(rows).join(over, "source").mapInPandas(_look_up, "row_id bigint, line_no bigint")


def without_repeated_lines(articles: DataFrame, least_rows: int = 5, least_share: float = 0.02) -> DataFrame:
    """``(row_id, text)``: each text without those lines (null stays null)."""

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, templates in zip(b["extracted_text"], b["templates"], strict=True):
                over = set() if templates is None else set(templates.tolist())
                out.append(None if text is None else "\n".join(x for x in text.split("\n") if not over or template_hash(line_key(x)) not in over))
            yield pd.DataFrame({"row_id": b["row_id"], "text": out})

    over = repeated_templates(articles, least_rows, least_share)
    rows = articles.select("row_id", F.coalesce("source", F.lit("")).alias("source"), "extracted_text")
    return rows.join(over, "source", "left").mapInPandas(strip, "row_id bigint, text string")
