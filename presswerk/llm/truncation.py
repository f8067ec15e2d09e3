"""Problem 2: values that a length limit or a broken transfer cut off.

One pass measures each value under several encodings and reads its ending. Lengths at which unusually many values of
one source and field stop openly are hidden storage limits; endings that could be either are settled by the limit, by
the fuller text of the same row, by the headlines of the corpus and by ellipses that writers set themselves.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.llm.repeated_lines import template_hash
from presswerk.llm.residue import residue_rows
from presswerk.llm.text import WORD, line_key, pattern
from presswerk.session import spread, stage

FIELDS = ("summary", "content_for_ai")

# The encodings in which a store or a transfer may have counted.
MEASURES = {
    "chars": len,
    "utf8": lambda s: len(s.encode("utf-8", "surrogatepass")),
    "utf16": lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2,
    "html": lambda s: len(html.escape(s)),
    "html_utf8": lambda s: len(html.escape(s).encode("utf-8", "surrogatepass")),
    "json": lambda s: len(json.dumps(s)) - 2,
    "json_utf8": lambda s: len(json.dumps(s, ensure_ascii=False).encode("utf-8", "surrogatepass")) - 2,
    "crlf": lambda s: len(s) + s.count("\n") - s.count("\r\n"),
}

# Marks that systems put where they cut.
_MARK = pattern(
    r"""(?:\[\s?\+?\d+ (?:more )?(?:chars|characters|words|Zeichen)\]?|\[(?:…|\.{3})\]|\((?:…|\.{3}|more|continued)\)|(?:…|\.{3})\s*(?:\(?(?:Read more|Continue reading|Read on|More|Weiterlesen|Mehr lesen|Mehr|Lire la suite|Suite|Leer más|Seguir leyendo)\b.{0,6})
    |(?<=\w )(?:Read more|Continue reading|Weiterlesen|Lire la suite|Leer más)\W*)$"""
)
_ELLIPSIS = re.compile(r"(?:…|\.{3,})[\"”»’')]*$")
_BROKEN = re.compile(r"(?:�+|&(?:#x?[0-9a-fA-F]{0,7}|[a-zA-Z]{1,8})|<[/!]?[a-zA-Z]{0,10}(?:\s[^<>]{0,60})?|\\u?[0-9a-fA-F]{0,3}|[\ud800-\udfff])$")
_END = re.compile(r"[.!?。！？؟।][\"”“»’')\]\s]*$")
_SENTENCE = re.compile(r"(?:(?<=[.!?。！？…])|(?<=[.!?…][\"”»’')]))\s+(?=\S)")
_ITEM = re.compile(r"(?:^|\s)(?=[-–•*] \S)")
# Endings that need no full stop (credits, contacts, tags, scores, pointers, subheads).
_PART = pattern(
    r"""^(?:(?:photos?|pictures?|images?|fotos?|bild(?:er)?|graphic|grafik|video|credits?|key ?words?|tags?|topics?|schlagw(?:ö|o)rter|themen|mots[- ]clés|palabras clave|etiquetas|contacts?|kontakt|contacto|details|e-?mail|source|quelle|fuente|text|write to)\s?: \S.{0,120}
    |(?:final score|full time|score|endstand|ergebnis|score final|resultado(?: final)?|marcador)\s?: .{1,20}\d.{0,50}\d\W*|\(.{2,50}\)|[—–] .{2,60}|(?:#\w+[ ,]*)+
    |(?:more on|mehr am|suite|más el) \w+.{0,40}|[-–•*] .{2,80}: ?[\d.,]+(?: (?:percent|per cent|million|billion|prozent|millionen|pour cent|por ciento|%|euros?))?|[-–•*] [^:]{2,80}
    |["“„«'] ?(?:\w+ ?){1,4},?["”“»'],? (?:said|says|stated|added|told|sagte|a dit|dijo)\b.{3,60}
    |(?:what|how|why|where|who|when|was|wie|warum|comment|pourquoi|qué|cómo|por qué)\b.{3,70}(?:\bnext|\bon|\bnow)|https?://\S+|\S+@\S+\.\w{2,})$"""
)
SCHEMA = "row_id bigint, source string, field string, ending string, text_key bigint, tail_key bigint, lengths array<int>"
EVIDENCE_SCHEMA = "kind string, key bigint"


def _rest(end: str, fuller: str | None) -> str | None:
    """What follows ``end`` in the line of the fuller text that has it, or None if no line has it."""
    tail = " ".join(end.split())[-32:]
    if fuller and len(tail) >= 8:
        for line in fuller.split("\n"):
            flat = " ".join(line.split())
            at = flat.find(tail)
            if at >= 0:
                return flat[at + len(tail) :]
    return None


def ending(value: str, title: str | None = None, fuller: str | None = None) -> str:
    """How a value ends: ``cut``, ``ended``, ``stopped``, ``ellipsis``, ``part``, ``headline``, ``open_headline`` or ``blank``.

    ``cut`` and ``ended`` are final. ``stopped`` values end with a point inside a sentence of the fuller text (an
    abbreviation, a number); they and a ``part`` are complete unless they stand at a storage limit. An ``ellipsis`` is a
    cut at a limit, and elsewhere unless writers use its sentence; an ``open_headline`` is complete if any row has it as
    its headline.
    """
    text = value.strip()
    if not text:
        return "blank"
    if _MARK.search(text) or _BROKEN.search(text):
        return "cut"
    if _ELLIPSIS.search(text):
        return "ellipsis"
    last = _SENTENCE.split(text)[-1]
    item = _ITEM.split(last)[-1]
    if _END.search(text):
        # a number may have been cut at its point, and a list item has no full stop
        doubtful = re.search(r"\d\.$", text)
        rest = (_rest(text, fuller) or "") if text[-1] == "." else ""
        if doubtful and (item[:2] in ("- ", "– ", "• ") or rest[:1].isdigit()):
            return "cut"
        return "stopped" if rest.strip()[:1].islower() or rest[:1].isalnum() else "ended"
    key = line_key(last)
    if _PART.match(key) or _PART.match(line_key(item)):
        return "cut" if _rest(item, fuller) else "part"
    if last == text:
        if _rest(text, fuller):
            return "cut"
        own, mine = set(WORD.findall((title or "").lower())), set(WORD.findall(text.lower()))
        alike = len(own & mine) >= 0.6 * max(len(own), len(mine), 1)
        return "headline" if alike else "open_headline"
    return "cut"


def _tail_of(text: str) -> str:
    """The last sentence without its ellipsis, as a key."""
    return line_key(_ELLIPSIS.sub("", _SENTENCE.split(text.strip())[-1]))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for row, source, title, fuller, *values in zip(b["row_id"], b["source"], b["title"], b["extracted_text"], *(b[f] for f in FIELDS), strict=True):
            for field, value in zip(FIELDS, values, strict=True):
                if value is None:
                    continue
                kind = ending(value, title, fuller)
                out.append(
                    (
                        row,
                        source,
                        field,
                        kind,
                        template_hash(line_key(value)) if kind == "open_headline" else None,
                        template_hash(_tail_of(value)) if kind == "ellipsis" else None,
                        [f(value) for f in MEASURES.values()],
                    )
                )
        frame = pd.DataFrame(out, columns=["row_id", "source", "field", "ending", "text_key", "tail_key", "lengths"], dtype=object)
        # with nulls among them the keys would turn into floats and lose digits
        yield frame.assign(**{k: pd.array(frame[k], dtype="Int64") for k in ("row_id", "text_key", "tail_key")})


def _writers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Headlines, and the sentences that end a line of a full text with an ellipsis, as keys."""
    for b in batches:
        heads = {template_hash(line_key(t)) for t in b["title"] if t}
        tails = set()
        for text in b["extracted_text"]:
            if text and ("…" in text or "..." in text):
                for line in text.split("\n"):
                    if _ELLIPSIS.search(line.strip()):
                        tails.add(template_hash(_tail_of(line)))
        yield pd.DataFrame([("headline", h) for h in heads] + [("ellipsis", t) for t in tails], columns=["kind", "key"])


def storage_limits(measured: DataFrame, least: int = 5, least_share: float = 0.15, mostly: float = 0.5) -> DataFrame:
    """``(field, source, measure, length, n)``: lengths at which values of a source stop openly far too often.

    A limit is a length, under one measure, of at least ``least`` values that stop openly, of at least ``least_share`` of
    all of the source's values that do, and at which most values of that length stop so. Counted by value length first,
    so hot sources are added up in their tasks.
    """
    opened = F.col("ending").isin("cut", "ellipsis")
    long = measured.select("field", "source", opened.alias("opened"), F.posexplode("lengths").alias("measure", "length"))
    counts = long.groupBy("field", "source", "measure", "length").agg(F.count_if("opened").alias("n"), F.count("*").alias("all"))
    totals = measured.where(opened).groupBy("field", "source").agg(F.count("*").alias("total"))
    over = counts.where((F.col("n") >= least) & (F.col("n") >= F.col("all") * mostly)).join(totals, ["field", "source"])
    return over.where(F.col("n") >= F.col("total") * least_share).select("field", "source", "measure", "length", "n")


def measured_values(articles: DataFrame) -> DataFrame:
    """How each value of the fields ends and how long it is under each of ``MEASURES``."""
    columns = ["row_id", "source", "title", "extracted_text", *FIELDS]
    return stage(spread(articles.select(*columns)).mapInPandas(_measure, SCHEMA), "endings")


def source_limits(articles: DataFrame) -> DataFrame:
    """``(field, source, measure, length, n)``: the hidden storage limits of all sources, the measure by its name."""
    names = F.array(*(F.lit(m) for m in MEASURES))
    return storage_limits(measured_values(articles)).withColumn("measure", F.get(names, F.col("measure")))


def judge_values(articles: DataFrame) -> DataFrame:
    """``(row_id, source, field, cut)`` for every value of ``summary`` and ``content_for_ai`` that isn't null.

    Needs ``row_id, source, title, extracted_text`` and the two fields; nulls in them only take evidence away. Blank
    values are complete. ``content_for_ai`` of rows without news (problem 7) is never cut. Repeated rows stay.
    """
    measured = measured_values(articles)
    known = stage(spread(articles.select("title", "extracted_text")).mapInPandas(_writers, EVIDENCE_SCHEMA).distinct(), "writers")
    limits = (
        storage_limits(measured)
        .groupBy("field", "source")
        .agg(F.collect_list(F.struct("measure", "length")).alias("limits"))
    )  # at most measures / least_share entries a source
    heads = known.where("kind = 'headline'").select(F.col("key").alias("text_key"), F.lit(True).alias("is_head"))
    tails = known.where("kind = 'ellipsis'").select(F.col("key").alias("tail_key"), F.lit(True).alias("is_tail"))
    settled = measured.where(F.col("ending").isin("cut", "ended", "blank", "headline")).select("row_id", "source", "field", (F.col("ending") == "cut").alias("cut"))
    headline = measured.where("ending = 'open_headline'").join(heads, "text_key", "left").select("row_id", "source", "field", F.col("is_head").isNull().alias("cut"))
    at_limit = F.exists(F.coalesce("limits", F.array()), lambda x: F.get("lengths", x["measure"]) == x["length"])
    limited = measured.where("ending IN ('ellipsis', 'part', 'stopped')").join(limits, ["field", "source"], "left").withColumn("at_limit", at_limit)
    dots = limited.where("ending = 'ellipsis'").join(tails, "tail_key", "left").select("row_id", "source", "field", (F.col("at_limit") | F.col("is_tail").isNull()).alias("cut"))
    part = limited.where("ending != 'ellipsis'").select("row_id", "source", "field", F.col("at_limit").alias("cut"))
    judged = settled.unionByName(headline).unionByName(dots).unionByName(part)
    no_news = residue_rows(articles).select("row_id", F.lit("content_for_ai").alias("field"), F.lit(True).alias("no_news"))
    return judged.join(no_news, ["row_id", "field"], "left").select("row_id", "source", "field", (F.col("cut") & F.col("no_news").isNull()).alias("cut"))


def truncation_rates(judged: DataFrame) -> DataFrame:
    """``(source, n_values, n_cut, share)``: how often a source's values of either field are cut."""
    n_cut = F.count_if("cut")
    return judged.groupBy("source").agg(F.count("*").alias("n_values"), n_cut.alias("n_cut"), F.round(n_cut / F.count("*"), 6).alias("share"))
