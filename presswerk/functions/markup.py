"""Paragraphs of web pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswerk.functions.text import col, collapse, distinct_ignoring_case, let, strip_markup

# The patterns by which blocks of a page are found.
COMMENT = r"(?s)<!--.*?-->"
NOISE = r"(?is)<(script|style|noscript|svg|iframe|template|form|nav|footer|header)[^>]*>.*?</\1>"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article>"
MAIN = r"(?is)<main\b[^>]*>(.*?)</main>"
CONTENT = r"""(?is)<(?:div|section)\b[^>]*(?:id|class)\s*=\s*['"][^'"]*(?:article|content|story|post|entry|main|body)[^'"]*['"][^>]*>(.*?)</(?:div|section)>"""
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"
LEAST_PARAGRAPH = 40


def without_noise(page: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(page), COMMENT, " "), NOISE, " ")


def decode_common(c: Column) -> Column:
    """The entities that pages use most, as expressions; ``functions.text.unescape`` has all of them."""
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def paragraphs(fragment: str | Column) -> Column:
    """The paragraphs of at least 40 characters, each once (case ignored)."""
    raw = F.regexp_extract_all(F.coalesce(col(fragment), F.lit("")), F.lit(PARAGRAPH), F.lit(1))
    clean = F.transform(raw, lambda p: collapse(strip_markup(decode_common(p)), empty=True))
    return distinct_ignoring_case(F.filter(clean, lambda p: F.length(p) >= LEAST_PARAGRAPH))


def _longest_block(bare: Column) -> Column:
    blocks = F.concat(*[F.regexp_extract_all(bare, F.lit(p), F.lit(1)) for p in (ARTICLE, MAIN, CONTENT)])
    texts = F.transform(blocks, lambda b: F.array_join(paragraphs(b), "\n"))
    best = F.aggregate(texts, F.lit(""), lambda got, t: F.when(F.length(t) > F.length(got), t).otherwise(got))
    return F.nullif(best, F.lit(""))


def _all_paragraphs(bare: Column) -> Column:
    return F.nullif(F.array_join(paragraphs(bare), "\n"), F.lit(""))


def readable_text(page: str | Column) -> Column:
    """The longest joined paragraphs of any article, main or content block, or null; the first of equals."""
    return let(without_noise(page), _longest_block)


def paragraph_text(page: str | Column) -> Column:
    """All paragraphs of the page, or null."""
    return _all_paragraphs(without_noise(page))


def extracted(page: str | Column, least_chars: int = 400) -> Column:
    """``struct(text, status, method)`` of a page: by block, else by paragraphs, else failed.

    The page is stripped of noise once, and read for loose paragraphs only if no block has any.
    """

    def graded(found: Column) -> Column:
        text = found["text"]
        status = F.when(text.isNull(), "failed").when(F.length(text) >= least_chars, "ok").otherwise("partial")
        return F.struct(text.alias("text"), status.alias("status"), F.when(text.isNull(), "none").otherwise(found["method"]).alias("method"))

    def chosen(bare: Column) -> Column:
        def either(block: Column) -> Column:
            return F.when(block.isNotNull(), F.struct(block.alias("text"), F.lit("readability").alias("method"))).otherwise(
                F.struct(_all_paragraphs(bare).alias("text"), F.lit("paragraph_fallback").alias("method"))
            )

        return let(_longest_block(bare), either)

    return let(let(without_noise(page), chosen), graded)
