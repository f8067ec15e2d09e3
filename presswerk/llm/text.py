"""Text kernels shared by the operators of this subpackage."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")


def pattern(text: str) -> re.Pattern:
    """One regular expression from the lines of ``text``, joined as they stand."""
    return re.compile("".join(x.strip() for x in text.splitlines()))


def alternatives(text: str) -> list[str]:
    """The alternatives of an expression given in lines, parted at the bars that stand in no bracket."""
    out, depth = [""], 0
    for c in re.findall(r"\\.|.", "".join(x.strip() for x in text.splitlines())):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def line_key(line: str) -> str:
    """The form under which two lines are the same: trimmed, white space and digit runs folded, lower case."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


# The commonest function words of the four languages of the sources.
STOPWORDS = frozenset(
    """a an the and or but of to in on at by for from with as is are was were be been it its this that these those he she
    they we you i his her their our your not no nor so if than then there here who whom which what when where while after
    before over under between into against up down out about more most may will would can could should has have had do does
    did all any each
    der die das den dem des ein eine einen einem einer und oder aber von zu zum zur in im an am auf bei für mit aus nach vor
    über unter ist sind war waren wird werden nicht kein sie er es wir ihr man sich auch als wie wenn dass um bis durch trotz
    le la les un une des du de et ou mais à au aux en dans sur sous par pour avec sans est sont était ont a il elle ils elles
    nous vous ce cette ces qui que quoi dont où ne pas plus son sa ses leur leurs se après malgré
    el los las una unos unas y o pero del al con sin por para sobre entre hasta es son era fue fueron ha han su sus se no más
    que como si lo les nos tras pese""".split()
)
