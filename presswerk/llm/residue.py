"""Problem 7: template residue, filler and error pages in place of news.

Row evidence (placeholder detectors, wording of error pages, filler without function words, and how far slug and title
share terms with the body) is a map. Host evidence is an aggregate: an opening line that one host or source gives over
many different headlines, in bodies that say nothing of what slug and title announce, is a response of the system.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.llm.boilerplate import GOOD, decide, is_article_part, page_lines
from presswerk.llm.text import STOPWORDS, WORD, alternatives, line_key, pattern
from presswerk.session import spread, stage

# The syntaxes of template places.
_PLACE = pattern(
    r"""\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{1,60}\}|<%[^%\n]{0,80}%>|\{%[^%\n]{0,80}%\}|#\{[^{}\n]{1,60}\}|%%\w+%%|@@\w+@@|\[\[\s?[\w. ]{2,40}\]\]
    |(?<!\w)__[A-Z][A-Z_]+__(?!\w)|%\(\w+\)[sdf]|(?<![\w$#{])\{\d{1,2}\}|<<\s?\w[\w ]{1,30}>>|\*\|\w+\|\*|\$[A-Z][A-Z_]+\$|(?<!\w)\$[A-Z]+_[A-Z_]+
    |\[(?:Company|Team|Author|Reporter|Editor|Your|City|Place|Location|Date|Name|Title|Headline|Insert|INSERT|TK|TKTK|TBD|PLACEHOLDER|Placeholder|NAME|DATE|CITY|QUOTE)\b[^\]\n]{0,40}\]
    |<insert [^>\n]{1,40}>|\bXX+ [A-Z][A-Z ]{2,40} XX+\b|\bTKTK\b|\[/?(?:caption|gallery|embed|shortcode)\b[^\]]*\]"""
)
# What programs print for a missing value.
_EMPTY = re.compile(r"\[object Object\]|(?<![\w-])(?:undefined|NaN|\(null\)|<null>|NULL)(?![\w-])|(?<=[a-z,] )(?:None|null)(?= [a-z])|\bInvalid Date\b")
# A place or value that the sentence talks about: in code marks or quotes, or after a noun that names it.
_MENTION_BEFORE = re.compile(
    r"(?:<code>\s*|[\"“„«‘'`]\s*|\b(?:strings?|texts?|words?|values?|phrases?|placeholders?|codes?|tags?|expressions?|messages?|variables?|tokens?|syntax|marks?|called|named|reads?|says?|printed|typed|literal|label(?:led)?)\s+)$", re.I
)
_MENTION_AFTER = re.compile(r"^\s*(?:</code>|[\"”»’'`])")
# Wording of error, block, maintenance and script notices, over line keys.
_NOTICES = alternatives(
    r"""^(?:http )?(?:error |status )?0:? ?(?:\W )?(?:not found|forbidden|bad gateway|bad request|unauthorized|gone|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|request timeout)
    |^http error 0|^error 0 ?:|^fehler 0 ?:|^erreur 0 ?:|^(?:page|seite|site) not found|page you (?:are looking|requested|were looking)|(?:could not|cannot|can['’]t|couldn['’]t) (?:find|locate) (?:that|this|the) (?:story|page|article)
    |requested (?:article|page|url|resource) (?:is|was|could|has|does)|^access (?:denied|to this page)|do not have permission|not available in your (?:region|country)|^too many requests|slow down and retry|^something went wrong|unexpected error (?:occurred|has)
    |error establishing a database|database connection|scheduled maintenance|(?:site|we) (?:is|are) down for|back (?:within|shortly|soon)|temporarily unavailable|please try again later|reload the page
    |(?:enable|turn on|activate|requires?|need) (?:javascript|scripts|cookies)|javascript is (?:disabled|required|not)|enable scripts|cookies and (?:scripts|javascript)|checking your browser|verify (?:that )?you are (?:a )?human|are you a robot|complet(?:e|ing) the (?:challenge|captcha)
    |ad ?blocker|browser is (?:out of date|not supported|outdated)|unsupported browser|^loading\.\.\.
    |^traceback|template render failed|\b\w*exception at \S|^\w+(?:\.\w+)+(?:exception|error)\b|^\{\"?(?:error|code|message|status)\"?\s?:|upstream timed out|stack trace|^fatal error|^warning: \w+\(|^uncaught \w+
    |zugriff verweigert|keine berechtigung für diese seite|wartungsarbeiten|(?:seite|dienst|inhalt) (?:ist |wurde )?(?:derzeit |vorübergehend )?nicht (?:verfügbar|erreichbar|gefunden)|seite wurde nicht gefunden|aktivieren sie javascript|javascript (?:ist )?(?:deaktiviert|aktivieren)|browser wird (?:geprüft|überprüft)|diese seite benötigt
    |page demandée (?:est )?introuvable|accès refusé|activer javascript|site en maintenance|service momentanément indisponible|vérification de votre navigateur|vérifions votre navigateur|n['’]êtes pas autorisé
    |página solicitada no existe|acceso denegado|no tiene permiso para ver|active javascript|activar javascript|sitio en mantenimiento|servicio no disponible|comprobando su navegador|página no encontrada"""
)
# Filler that stands until the text is there.
_FILLERS = alternatives(
    r"""\blorem ipsum\b|^(?:asdf|qwer|xxx+|test|bla+h?|foo|bar|dummy)(?: (?:asdf|qwer|xxx+|test|bla+h?|foo|bar|please ignore|dummy|text))+\b|^body copy goes here|text goes here|^dummy text\b|placeholder,|^headline placeholder
    |^this is a (?:sample|test|dummy|placeholder) (?:paragraph|text|article|story)|(?:article|story|body) text will appear here|replace (?:this|before) publishing|^insert (?:text|body|copy) here|^type your text|^click to (?:edit|add) text|^sample text|beispieltext|blindtext|^texte? (?:d['’])?exemple|texto de (?:ejemplo|relleno)"""
)
# What stands at the beginning of a line is tried there only, the rest only in lines that hold a part of it.
_AT_START = re.compile("|".join(x for x in (*_NOTICES, *_FILLERS) if x.startswith("^")))
_WITHIN = re.compile("|".join(x for x in (*_NOTICES, *_FILLERS) if not x.startswith("^")))
# A part of each wording that may stand anywhere in a line.
_STEMS = (
    "page you", "find", "locate", "unexpected error", "slow down", "requested", "permission", "not available", "database", "maintenance", "down for", "back ", "unavailable", "try again", "reload", "javascript", "scripts", "cookies", "browser", "human", "robot", "complet",
    "blocker", "render failed", "exception", "timed out", "stack trace", "zugriff", "berechtigung", "wartungs", "nicht", "seite", "introuvable", "accès refusé", "indisponible", "navigateur", "autorisé", "solicitada", "denegado", "permiso",
    "mantenimiento", "no disponible", "navegador", "no encontrada", "lorem", "goes here", "placeholder", "appear here", "publishing", "beispieltext", "blindtext", "exemple", "ejemplo", "relleno",
)
_FOLDED = re.compile(r"[0-9a-f]*\d[0-9a-f]*", re.I)  # numbers and ids
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^@/?#]*@)?(?:www\d?\.|m\.|amp\.)?([^/?#:]+)", re.I)
NOTICE_CHARS = 160
NEWS_SPACES = 80  # a body of more is a page that also says something
SCHEMA = "row_id bigint, source string, host string, residue boolean, opening bigint, headline bigint, strange boolean"


def _mentioned(text: str, start: int, end: int) -> bool:
    return bool(_MENTION_BEFORE.search(text[max(0, start - 24) : start])) or bool(_MENTION_AFTER.match(text[end : end + 12]) and re.search(r"<code>|[\"“„«‘`]", text[max(0, start - 40) : start]))


def unfilled(text: str) -> bool:
    """A place that nobody filled, or the empty value of a program, outside what the text talks about."""
    if not any(c in text for c in "{[<%#@_$*") and "XX" not in text and "TKTK" not in text and not _EMPTY.search(text):
        return False
    return any(not _mentioned(text, m.start(), m.end()) for p in (_PLACE, _EMPTY) for m in p.finditer(text))


def assess(text: str, title: str | None, url: str | None) -> tuple[bool, str, bool]:
    """``(residue, opening line, strange)`` of one body.

    ``residue`` follows from the row alone. A body is ``strange`` to its address if its opening, the first block
    that reads as its text, shares no term with slug and title and neither do most of its blocks; its opening line, numbers and ids folded, goes into the host evidence.
    """
    if unfilled(text):
        return True, "", False
    lines = [x for x in text.split("\n") if x.strip()]
    keys = [line_key(x) for x in lines]
    if not keys:
        return False, "", False
    kinds = [_kind(k) for k in keys]
    bare, residue = any(kinds) or text.count(" ") <= NEWS_SPACES, False
    if bare:
        furniture = set(page_lines("\n".join(lines)))
        own = [i for i in range(len(keys)) if i + 1 not in furniture] or range(len(keys))
        keys, kinds, lines = ([x[i] for i in own] for x in (keys, kinds, lines))
        residue = kinds[0] or sum(kinds) * 2 > len(kinds)
    if not residue and next((w for k in keys for w in WORD.findall(k) if w in STOPWORDS), None) is None:
        plain = [w for k in keys for w in WORD.findall(k) if not w.isdigit()]
        # no language has sentences without function words
        residue = len(plain) >= 8 and sum(len(WORD.findall(k)) >= 6 for k in keys) * 2 >= len(keys)
    opening = next((k for k, x in zip(keys, lines, strict=True) if not is_article_part(k) and (bare or decide(k, x.strip()) == GOOD)), "")
    named = _terms(f"{title or ''} {(url or '').rpartition('/')[2]}")
    if not opening or named & _terms(opening):
        return residue, "", False
    shared = sum(any(w in k for w in named) for k in keys)
    return residue, _FOLDED.sub("0", opening), shared * 2 <= len(keys)


def _terms(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if len(w) > 3 and w not in STOPWORDS}


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url.strip()) if url else None
    return found[1].lower() if found else None


def is_placeholder(title: str) -> bool:
    """Whether a headline is an unfilled place, filler or the heading of an error page."""
    return unfilled(title) or _kind(line_key(title)) or line_key(title) in {"untitled", "untitled document", "headline", "no title", "new document", "ohne titel", "sans titre", "sin título"}


@lru_cache(maxsize=50_000)
def _kind(key: str) -> bool:
    """A line that speaks as an error page or filler: a short one in any part, a long one in its beginning, as reports
    quote such words later on."""
    if _AT_START.match(key):
        return True
    if not any(stem in key for stem in _STEMS):
        return False
    if len(key) <= NOTICE_CHARS:
        return bool(_WITHIN.search(key))
    found = _WITHIN.search(key, 0, NOTICE_CHARS)
    return bool(found) and found.start() <= NOTICE_CHARS // 4


def _assess_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [assess(x, t, u) for x, t, u in zip(b["extracted_text"], b["title"], b["url"], strict=True)]
        yield pd.DataFrame(
            {
                "row_id": b["row_id"],
                "source": b["source"],
                "host": [host_of(u) for u in b["url"]],
                "residue": [g[0] for g in got],
                "opening": [xxhash.xxh3_64_intdigest(g[1].encode("utf-8", "surrogatepass")) - (1 << 63) for g in got],
                "headline": [_headline(t) for t in b["title"]],
                "strange": [g[2] for g in got],
            }
        )


def _headline(title: str | None) -> int:
    """A number for the headline that desk marks and small edits leave alone: its longest word."""
    word = min(WORD.findall((title or "").lower()), key=lambda w: (-len(w), w), default="")
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def host_openings(seen: DataFrame, least_headlines: int = 5) -> DataFrame:
    """``(site, opening)``: opening lines that a site gives over at least ``least_headlines`` different headlines, in
    bodies that are strange to their addresses. A site is a host, or a source (whose rows without url count too).

    Counted per headline first, so an opening that a third of the rows share is added up in their tasks.
    """
    sites = seen.where("strange").select(F.explode(_sites()).alias("site"), "opening", "headline").where("site IS NOT NULL")
    counts = sites.distinct().groupBy("site", "opening").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_headlines).select("site", "opening")


def _sites() -> Column:
    return F.array(F.concat(F.lit("host "), "host"), F.concat(F.lit("source "), F.coalesce("source", F.lit(""))))


def residue_rows(articles: DataFrame, least_headlines: int = 5) -> DataFrame:
    """``row_id`` of the rows whose ``extracted_text`` is residue, each once.

    Needs ``row_id, source, title, url, extracted_text``; nulls in title, url and source count as empty, rows with a null
    or blank text or without an id are no residue. A body that is strange to its address is residue as well if its
    opening line is one that its host or source gives over many headlines (see ``host_openings``).
    """
    rows = articles.where(F.col("extracted_text").isNotNull() & F.col("row_id").isNotNull()).select("row_id", "source", "title", "url", "extracted_text")
    seen = stage(spread(rows).mapInPandas(_assess_batches, SCHEMA), "residue")
    common = host_openings(seen, least_headlines)
    alone = seen.where("strange").select("row_id", "opening", F.explode(_sites()).alias("site")).join(common, ["site", "opening"], "left_semi").select("row_id")
    return seen.where("residue").select("row_id").unionByName(alone).distinct()
