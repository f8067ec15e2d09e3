"""Problem 4: the lines of a page that are not the article.

Two passes over the lines (blocks) of one text. The first decides a block by itself: one that lies mostly in links of the
page, or that speaks as pages do, is of the page; a sentence or long block with the stop words of prose is of the article.
The second gives each block that is still open the label of the nearest decided neighbours. The rules read one text at a time, so
the operator is a map over the rows and needs no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.llm.text import STOPWORDS, WORD, alternatives, line_key, pattern
from presswerk.session import spread

GOOD, BAD, OPEN, LABEL = 1, 2, 0, 3  # LABEL: the heading of a list of other stories; bad, and so is its list
LINKED = 0.66  # a block is of the page if so much of it is links
LITTLE_PROSE, MUCH_PROSE = 0.06, 0.2  # share of stop words in a sentence, and in a long block without an end mark
FURNITURE_WORDS = 40

# Wording of page furniture in English, German, French and Spanish, over line keys.
_BAD_PARTS = alternatives(
    r"""^©|^\(c\)\s*0|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados
    |reproduction in whole|toute reproduction|prohibida la reproducción|nachdruck,? auch|vervielfältigung
    |\buses? cookies (?:to|for|and)\b|\bcookie (?:policy|settings)|^cookie notice$|use of cookies|which cookies|setzen von cookies|verwendet cookies|cookies und ähnliche
    |cookies propias|uso de cookies|utilisation de cookies|déposent des cookies|des traceurs|accept (?:all|cookies)|alle akzeptieren|tout accepter|aceptar todo
    |store and access information on|speichern informationen auf|almacenan información en|stores small files on your|your privacy matters|we value your privacy
    |^terms of (?:use|service)|privacy ·|^impressum\b|datenschutz ·|^mentions légales|confidentialité ·|^aviso legal|privacidad ·|\badvertise with us
    |do not sell or share|do not sell my|quotes are delayed|not investment advice|keine anlageberatung|not responsible for the content|übernimmt .{0,40}keine haftung|décline toute responsabilité|no se hace responsable
    |^support (?:local|independent|our) journalism|^subscribe\b|\bsubscribe (?:to|now)\b.{0,60}\b(?:from|for|today)\b|jetzt .{0,40}abonnieren|^abonnez-vous|^suscríbase|^sign up (?:for|to)\b|^get (?:our|the) .{0,40}\b(?:newsletter|app)\b
    |^melden sie sich .{0,60}an|^recevez (?:chaque|tous)|^reciba (?:cada|todos)|^download (?:our|the) .{0,30}app
    |^already a (?:member|subscriber)|^bereits abonnent|^déjà abonné|^¿?ya es suscriptor|^log in\b|^sign in\b|^register (?:now|free|to)\b
    |^share (?:this|on|via)\b|^artikel teilen|^partager (?:cet|sur)|^compartir (?:esta|este|en)\b|^follow us\b|^send a tip\b|^save this (?:story|article)|^gift this|^print this
    |^(?:view |read |see |show )?(?:all )?(?:0 )?(?:comments|kommentare|commentaires|comentarios)\b.{0,14}$|^réagir\b|^(?:leave|post) a comment|^join the (?:conversation|discussion)
    |people are reading this|^story continues below|^article continues|^continue reading|^weiterlesen|^lire la suite|^seguir leyendo
    |^(?:advertisement|advertising|anzeige|werbung|publicité|publicidad|sponsored(?: content)?|paid (?:post|content)|promoted(?: content)?|contenu sponsorisé|contenido patrocinado)(?: \W.*)?$
    |^(?:read also|see also|also read|read more|read next|more on this|more|related|watch|listen|don['’]t miss|sehen sie auch|lesen sie auch|lesen sie mehr|mehr dazu|à lire aussi|lire aussi|voir aussi|lea también|vea también|más)\s*[:|»>]\s*\S
    |^back to (?:top|home)|^skip to|^menu$|^search$|^(?:next|previous) (?:article|story)|^jump to|^newsletter"""
)
# Headings of lists of other stories.
_LABEL = pattern(
    r"""^(?:most (?:read|popular|viewed|shared)|trending(?: now)?|popular now|related(?: stories| articles| news| content)?|you (?:may|might) also like|recommended(?: for you)?|editor['’]?s['’]? picks?
    |more (?:from|on|in) .{2,40}|more stories|latest (?:news|stories)|top stories|also in the news|what to read next|up next|read (?:also|next)|see also
    |mehr zum thema|meistgelesen|das könnte sie auch interessieren|weitere artikel|auch interessant|lesen sie auch|beliebt|empfehlungen
    |les plus lus|à lire aussi|sur le même sujet|à lire également|les plus partagés|nos recommandations|voir aussi
    |lo más (?:leído|visto)|le puede interesar|te puede interesar|noticias relacionadas|más noticias|lea también|además)\s*:?$"""
)
# Parts of an article that are no prose, over line keys.
_OWN = pattern(
    r"""^(?:by|von|par|por)\s(?!qué\b|continuing|using|browsing|clicking|signing).{2,70}[^.!?]$|\bbureau\b.{0,4}reporting by|^(?:additional )?reporting by|^mitarbeit\b|^avec la contribution
    |^(?:last )?updated\b|^aktualisiert\b|^zuletzt aktualisiert|^mis à jour|^mise à jour|^actualizado|^publi(?:shed|é|cado)\b|^editor['’]s note|^note to readers|^correction\b|^clarification\b|^berichtigung|^anmerkung der redaktion|^note de la rédaction|^nota de la redacción
    |^this is a developing story|^developing story|^.{2,60}\(.{2,60}\)\s*[—–-]+$|^\(.{2,60}\)$|^[—–]\s?.{2,60}$
    |^(?:photos?|pictures?|images?|fotos?|bild(?:er)?|caption|graphic|video|file photo|credits?|illustration|grafik)\s*:\s*\S
    |^(?:key ?words?|tags?|topics?|schlag(?:wörter|worte)|themen|mots[- ]clés|palabras clave|etiquetas)\s*:\s*\S|^#\w
    |^(?:contacts?|kontakt|contacto|details|e-?mail|phone|tel)\s*:\s*\S|^(?:final score|score|endstand|ergebnis|score final|resultado(?: final)?|marcador)\s*:
    |^[-–•*·]\s+\S|^\d+[.)]\s+\S|^https?://\S+$|^more on \w+day\b|^mehr am \w+tag\b"""
)
# What stands at the beginning of a line is tried there only, the rest only in lines that hold a part of it.
_BAD_START = re.compile("|".join(x for x in _BAD_PARTS if x.startswith("^")))
_BAD_WITHIN = re.compile("|".join(x for x in _BAD_PARTS if not x.startswith("^")))
# A part of each wording that may stand anywhere in a line.
_STEMS = (
    "rights reserved", "rechte vorb", "droits r", "derechos res", "reproduc", "nachdruck", "vervielf", "cookie", "traceurs", "accept", "akzeptier", "aceptar", "information", "información", "small files", "privacy", "datenschutz", "confidentialit",
    "privacidad", "advertise", "not sell", "delayed", "investment advice", "anlageberatung", "not responsible", "haftung", "responsab", "subscribe", "abonnier", "reading this",
)
_END = re.compile(r"[.!?…:;,][\"”’»)\]]*$")
_SEPARATED = re.compile(r"\s+[|·»›>/•]\s+|\s{2,}")
_QUOTED = re.compile(r"^[\"“«„‘'].{3,}[\"”»“’']")
_BLOCK = re.compile(r"<(?:p|li|h[1-6]|div|td|nav|aside|footer|header|section|form|ul|main|article)\b[^>]*>", re.I)
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


def is_article_part(key: str) -> bool:
    """Whether a line key is a byline, dateline, note, caption or another part of an article that is no prose."""
    return bool(_OWN.search(key))


def link_densities(page: str | None) -> dict[str, float]:
    """By line key, the share of each block's characters of ``raw_html`` that stand inside links."""
    found: dict[str, float] = {}
    if not page or "<a" not in page:
        return found
    for block in _BLOCK.split(page):
        if "<a" not in block:
            continue
        links = _LINK.findall(block)
        linked = sum(len(_TAG.sub("", x).strip()) for x in links)
        whole = _TAG.sub("", block).strip()
        if whole:
            found[line_key(html.unescape(whole))] = linked / len(whole)
        if len(links) > 1 and linked > 0.6 * len(whole):
            for x in links:
                found[line_key(html.unescape(_TAG.sub("", x)))] = 1.0
    return found


def _is_furniture(key: str, n: int) -> bool:
    """Whether a block of ``n`` words speaks as the page: once in a short one, in a long one all along."""
    found = int(bool(_BAD_START.match(key)))
    if (n > FURNITURE_WORDS or not found) and any(stem in key for stem in _STEMS):
        found += sum(1 for _ in _BAD_WITHIN.finditer(key))
    return found * FURNITURE_WORDS >= n > 0


@lru_cache(maxsize=50_000)
def decide(key: str, spaced: str, linked: float = 0.0) -> int:
    """What one block shows by itself; ``spaced`` is the trimmed line with its own spacing, ``linked`` the share of it
    that the page has as links."""
    if linked >= LINKED:
        return BAD
    found = WORD.findall(key)
    if not found:
        return OPEN
    n = len(found)
    if n <= 8 and _LABEL.match(key):
        return LABEL
    if _is_furniture(key, n):
        return BAD
    ended = bool(_END.search(key))
    prose = sum(w in STOPWORDS for w in found) / n
    if ended and n >= 18 and prose >= LITTLE_PROSE or _OWN.search(key):
        return GOOD
    if ended and n >= 3 and prose >= LITTLE_PROSE or n >= 25 and prose >= MUCH_PROSE:
        return GOOD
    if not ended:
        parts = [p for p in _SEPARATED.split(spaced) if p]
        if len(parts) >= 3 and all(len(p.split()) <= 3 for p in parts) and not any(c.isdigit() for c in key):
            return BAD
    return GOOD if _QUOTED.match(key) else OPEN


def _is_heading(line: str) -> bool:
    """A subhead of the article asks or promises something about it: what, how, why, where, who."""
    return bool(re.match(r"(?:what|how|why|where|who|when|was|wie|warum|wo|wer|ce que|comment|pourquoi|où|qué|cómo|por qué|dónde)\b.{3,60}$", line, re.I))


def page_lines(text: str | None, title: str | None = None, page: str | None = None) -> list[int]:
    """The numbers (from 1, blank lines counted) of the lines of ``text`` that belong to the page."""
    if not text:
        return []
    lines = text.split("\n")
    keys = [line_key(x) for x in lines]
    title_key = line_key(title or "")
    density = link_densities(page)
    label = [(GOOD if k == title_key else decide(k, x.strip(), density.get(k, 0.0))) if k else -1 for x, k in zip(lines, keys, strict=True)]
    solid = [i for i, v in enumerate(label) if v != -1]
    out = {i: label[i] for i in solid}
    at = 0
    while at < len(solid):
        if label[solid[at]] != OPEN:
            at += 1
            continue
        stop = at
        while stop < len(solid) and label[solid[stop]] == OPEN:
            stop += 1
        run = solid[at:stop]
        before = label[solid[at - 1]] if at else None
        after = label[solid[stop]] if stop < len(solid) else None
        shortest = [len(WORD.findall(keys[i])) for i in run]
        if before == LABEL:
            verdict = [BAD] * len(run)
        else:
            verdict = []
            for i, n in zip(run, shortest, strict=True):
                if n <= 4 and not _END.search(keys[i]) and not _is_heading(keys[i]):
                    verdict.append(BAD)  # a lone section name: no sentence, no function words
                elif before == BAD and after in (BAD, LABEL, None) or before is None and after in (BAD, LABEL):
                    verdict.append(BAD)
                else:
                    verdict.append(GOOD)
        out.update(zip(run, verdict, strict=True))
        at = stop
    return [i + 1 for i in solid if out[i] in (BAD, LABEL)]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [page_lines(x, t, h) for x, t, h in zip(b["extracted_text"], b["title"], b["raw_html"], strict=True)]
        yield pd.DataFrame({"row_id": b["row_id"].repeat([len(x) for x in found]).to_numpy(), "line_no": [n for x in found for n in x]})


def boilerplate_lines(articles: DataFrame) -> DataFrame:
    """``(row_id, line_no)`` of each line of ``extracted_text`` that belongs to the page.

    Needs ``row_id, title, raw_html, extracted_text``. Lines are split at ``\\n`` and counted from 1, blank ones
    counted but never given. A null or empty text has no lines; null title or page only take that evidence away.
    Repeated rows give their lines again, rows without an id none. Rows without news (see ``residue``) are for the caller to leave out.
    """
    rows = articles.where(F.col("extracted_text").isNotNull() & F.col("row_id").isNotNull()).select("row_id", "title", "raw_html", "extracted_text")
    return spread(rows).mapInPandas(_batches, "row_id bigint, line_no bigint")


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"row_id": b["row_id"], "text": [None if x is None else main_text(x, t, h) for x, t, h in zip(b["extracted_text"], b["title"], b["raw_html"], strict=True)]})


def main_bodies(articles: DataFrame) -> DataFrame:
    """``(row_id, text)``: each row's ``extracted_text`` without the lines of the page; null stays null, every row stays."""
    rows = articles.select("row_id", "title", "raw_html", "extracted_text")
    return spread(rows).mapInPandas(_bodies, "row_id bigint, text string")


def main_text(text: str | None, title: str | None = None, page: str | None = None, repeated: frozenset[int] = frozenset(), hashed=None) -> str:
    """``text`` without the lines of the page and without the lines whose key hashes into ``repeated``."""
    if not text:
        return ""
    away = set(page_lines(text, title, page))
    lines = text.split("\n")
    return "\n".join(x for i, x in enumerate(lines, 1) if i not in away and not (repeated and hashed(line_key(x)) in repeated))
