"""Problem 10: abusive, hateful and sexual content by compression distance.

Two zstandard dictionaries are trained, one on the toxic sentences of judged texts and a general lexicon of such
language, one on the ordinary sentences. Each window of a document (a few words of a sentence, disguises taken off) is
compressed with either; the bytes that the toxic dictionary saves over the ordinary one are its distance, which alone
decides. The threshold is calibrated on judged texts that the measuring dictionaries haven't seen.

Before it is compressed a window is written so that a word counts as a whole: a word of the training texts is followed
by letters of its own, so that a dictionary that has it saves much more than one that has a similar name; runs of words
that no training text has (mostly names) become one mark and numbers another, so they weigh on neither side; function
words stand as they are.

What costs most is kept from plain texts: an expression that undoes a disguise runs only where a cheaper test, which
finds all that it finds, does; sentences are parted by what stands between words; windows are short strings with one
sign for each word until they are compressed.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.llm.text import STOPWORDS, WORD
from presswerk.session import spread

MOST_EXAMPLES = 20_000  # bound of the judged texts read to fit the two dictionaries
WINDOW, STEP = 7, 3  # words of a window, and from one to the next
LEVEL = 4
LETTERS = 8  # that follow each word
FOLDS = 5
HELD = 200_000  # distances of windows that a task keeps
UNKNOWN, NUMBER = "~", "0"

# A general lexicon of insults, threats, contempt for groups and explicit sex in the languages of the
# sources, entries of at most three words.
LEXICON = """
abschaum, arschloch, asqueroso, asquerosos, asshole, assholes, aufhängen, bastard, bastards, beat him, beat you up, big tits, bitch, bitches, blowjob, brainless, break your, bring dich um, burn in hell, cabrón, casser la gueule, chatte,
clit, cock, cockroaches, cocksucker, cojones, connard, connards, coño, crawl back, cretin, crève, crétin, cum, cumshot, cunt, cunts, deep throat, dehors les, deserve to die, deserves to die, dick, die already, dirty people, disgusting,
drecksau, dreckig, dreckiger, drown yourself, dumbass, dégage, dégoûtant, enculé, exterminarlos, exterminate, exterminated, exterminer, faggot, fick dich, ficken, filth, filthy, follando, follar, fotze, foutre, fuck, fuck off, fuck you,
fucked, fucker, fucking, fuera de aquí, garbage, gas them, geil, geile, gilipollas, go back to, go die, go to hell, good for nothing, gueule, gutless, had sex, halt die fresse, handjob, hang them, hang yourself, hardcore, have sex with,
hijo de puta, hope you die, horny, hot girls, hure, hurensohn, hängt sie, i will kill, idiot, idiota, idiotas, idiots, imbecile, imbécil, imbécile, inferior race, jagt sie, keine menschen, kill them all, kill you, kill yourself,
a la mierda, lock them up, loser, losers, maricón, mierda, milf, missgeburt, mistkerl, moron, morons, motherfucker, muérete, nackt, nackte, naked, no son humanos, not human, nudes, ordure, orgasm, paliza, parasite, parasiten, parasites,
parásitos, pas humains, pathetic, pendejo, perra, piece of shit, polla, porn, porno, puant, puants, pussy, puta, putain, pute, rape you, ratas, rats, raus mit, raza inferior, retard, retarded, rot in hell, rotten, sale race, salope,
scheiße, schlampe, schwanz lutschen, schwein, screw you, scum, scumbag, send them back, sex tape, sex with, shit, shithead, shoot them all, should be shot, shut up, slut, sluts, spineless, spread your legs, stinkend, stinking, strip naked,
stupid, stupide, subhuman, suck my, tetas, tits, titten, trash, twat, ungeziefer, untermensch, useless, vais te tuer, vermin, vermine, verpiss dich, verprügeln, verrecke, vollidiot, voy a matar, wanker, watch your back, wet pussy,
where you live, whore, whores, wichser, wiped out, worthless, zorra"""
_ENTRIES = [e.split() for e in LEXICON.replace("\n", " ").split(", ")]

# Letters of other scripts and signs that stand for Latin letters in disguised words.
_LOOKALIKE = str.maketrans("аеорсухіїјѕԁһӏԛԝвкмнтгзбпилАЕОРСУХІВКМНТоο0αεικνρτυχ", "aeopcyxiijsdhlqwbkmhtrsbnnlAEOPCYXIBKMHToooaeiknptux")
_LEET = str.maketrans("013457@$", "oieastas")
_MARKS = re.compile("[­͏؜ᅟ​-‏‪-‮⁠-⁯︀-️﻿]")
_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_FOREIGN = re.compile("[\u0370-\u052f]")
_FOREIGN_WORD = re.compile("[^\\W\\d_]*[\u0370-\u052f][^\\W\\d_]*")
_LATIN = re.compile("[a-zA-Z]")
_MIXED = re.compile(r"[0-9@$](?:[a-zA-Z]|(?<=[a-zA-Z].))")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*·•~/|]{1,2}){2,}[^\W\d_](?![^\W\d_])")
_TWO_SPELLED = re.compile(r"[ .\-_*·•~/|][^\W\d_][ .\-_*·•~/|]{1,2}[^\W\d_](?![^\W\d_])")  # in all that _SPELLED finds
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_MASKED = re.compile(r"(?<![\w*])([^\W\d_]{1,3})([*#%@_]{1,12})([^\W\d_]{0,4})(?![\w*])")
_LEETED = re.compile(r"(?<![\w.,@$/-])(?=[^\s]*[a-zA-Z])(?=[\w@$]*[0-9@$])[a-zA-Z0-9@$]{3,}(?![\w@$/.-]*[/@]\w)")
_PARTS = re.compile(f"({WORD.pattern})")
_SENTENCE = re.compile(r"(?<=[.!?…;])[\"”»’')]*\s+|[\r\n]+|\s[—–]\s")

def _vocabulary() -> list[str]:
    return sorted({w for w in WORD.findall(LEXICON) if len(w) > 3}, key=lambda w: (-len(w), w))


_KNOWN = _vocabulary()
_SHORT = ("sex", "ass", "cum", "fag", "hoe")
_WORDS = frozenset(_KNOWN) | frozenset(_SHORT)
_INSIDE = re.compile("|".join(_KNOWN))


def _unspell(m: re.Match) -> str:
    """A word written letter by letter; the toxic words in it part it from what was joined to it."""
    joined = re.sub(r"[\W_]", "", m[0])
    return " ".join(_INSIDE.sub(lambda w: f" {w[0]} ", joined.lower()).split())


def _unmask(m: re.Match) -> str:
    """The first toxic word of the same length, beginning and end."""
    size = len(m[0])
    fits = (w for w in (*_KNOWN, *_SHORT) if len(w) == size and w.startswith(m[1].lower()) and w.endswith(m[3].lower()))
    return next(fits, m[0])


def _unlike(m: re.Match) -> str:
    """A word in which look-alikes stand beside Latin letters, or which look-alikes alone make a Latin word."""
    plain = m[0].translate(_LOOKALIKE)
    return plain if plain.isascii() or _LATIN.search(m[0]) else m[0]


def _unleet(m: re.Match) -> str:
    """A word with digits and signs for letters, if it then is a toxic word or was mostly letters anyway."""
    plain = m[0].translate(_LEET)
    mostly = sum(c.isalpha() for c in m[0]) * 2 >= len(m[0]) and "@" not in m[0]
    return plain if mostly or plain.lower() in _WORDS else m[0]


def _stretched(text: str) -> bool:
    """Whether some sign stands three times in a row, which costs much less than to seek letters that do."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = signs[1:] == signs[:-1]
    return bool((same[1:] & same[:-1]).any())


def undisguise(text: str) -> str:
    """The text as it reads: invisible and combining marks, look-alike letters, spelled-out and stretched words undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _MARKS.sub("", text))
        if _COMBINING.search(text):
            text = _COMBINING.sub("", text)
        if _FOREIGN.search(text):
            text = _FOREIGN_WORD.sub(_unlike, text)
    if "&" in text:
        text = html.unescape(text)
    if _stretched(text):
        text = _LONG.sub(r"\1", text)
    if "*" in text or "#" in text or "@" in text or "%" in text:
        text = _MASKED.sub(_unmask, text)
    if _TWO_SPELLED.search(text):
        text = _SPELLED.sub(_unspell, text)
    return (_LEETED.sub(_unleet, text) if _MIXED.search(text) else text).lower()


def known_words(texts: list[str]) -> frozenset[str]:
    """The words that weigh: those of the lexicon, and those that the texts somewhere write in small letters (names are
    always written with a capital)."""
    small = {w for t in texts for w in WORD.findall(t) if w.islower()}
    return frozenset(small | {w for e in _ENTRIES for w in e})


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The words of an undisguised text, and where its sentences begin among them. What parts sentences has no word in it,
    so it is sought between words."""
    parts = _PARTS.split(text)
    words = parts[1::2]
    ends = [i for i, gap in enumerate(parts[::2]) if gap != " " and (_parts_kept if len(gap) < 9 else _parts)(gap)]
    return words, [0] * bool(words) + [i for i in ends if 0 < i < len(words)]


def _parts(gap: str) -> bool:
    """Whether two sentences part between two words with this between them."""
    return _SENTENCE.search(gap) is not None


_parts_kept = functools.lru_cache(10_000)(_parts)


def tokens(words: list[str], known: frozenset[str]) -> list[str]:
    """The words of a sentence, unknown ones and numbers as one mark each; unknown ones in a row are one."""
    marked = [w if w in known else NUMBER if w.isdigit() else UNKNOWN for w in words]
    return [marked[i] for i in _firsts(marked, UNKNOWN)]


def _firsts(marked: Sequence[str], unknown: str) -> list[int]:
    """Where all begin but the unknown ones that follow another."""
    return [i for i, w in enumerate(marked) if w != unknown or not i or marked[i - 1] != unknown]


def windows(count: int) -> Iterator[tuple[int, int]]:
    """Where windows begin and end in so many words; the last ends with them, so every word stands in one."""
    last = max(count - WINDOW, 0)
    for at in range(0, last, STEP):
        yield at, at + WINDOW
    if count:
        yield last, count


_BOUNDS = [[*windows(count)] for count in range(200)]  # of the windows of usual sentences


def bounds(count: int) -> Iterable[tuple[int, int]]:
    return _BOUNDS[count] if count < len(_BOUNDS) else windows(count)


def _letters(word: str) -> str:
    number = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return "".join(chr(65 + (number >> 5 * i) % 26) for i in range(LETTERS))


def written(word: str) -> str:
    """A known word as it is compressed."""
    return word if word in STOPWORDS or word in (UNKNOWN, NUMBER) else word + _letters(word)


def compressible(words: list[str]) -> bytes:
    return (" " + " ".join(map(written, words))).encode("utf-8", "replace")


@dataclass
class Dictionaries:
    """What scoring needs: two dictionaries as bytes, the words that weigh, and the threshold in bytes of a window."""

    toxic: bytes
    ordinary: bytes
    known: frozenset[str] = frozenset()
    threshold: float = 0.0


def _train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples. Each is given several times, as training leaves out what occurs once; fewer than the
    trainer can use are a dictionary as they stand."""
    unique = list(dict.fromkeys(samples))
    size = sum(map(len, unique))
    try:
        return zstandard.train_dictionary(max(size * 3 // 2, 1024), unique * 4, k=2000, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(unique) or b"\n"


class Distances(dict):
    """The distances of windows, in which each known word is one sign (there are 1,114,080); the first ``HELD`` are kept."""

    def __init__(self, toxic: Callable[[bytes], bytes], ordinary: Callable[[bytes], bytes]) -> None:
        self._toxic, self._ordinary = toxic, ordinary
        self.signs: dict[str, str] = {}
        self._written: dict[str, str] = {}

    def sign(self, word: str) -> str:
        found = self.signs.get(word)
        if found is None:
            found = self.signs[word] = chr(32 + len(self.signs))
            self._written[found] = written(word)
        return found

    def __missing__(self, window: str) -> int:
        data = (" " + " ".join([self._written[c] for c in window])).encode("utf-8", "replace")
        found = len(self._ordinary(data)) - len(self._toxic(data))
        if len(self) < HELD:
            self[window] = found
        return found


class Scorer:
    """Compression distance of windows between the two dictionaries."""

    def __init__(self, held: Dictionaries) -> None:
        self.held = held
        self._seen = Distances(self._compressor(held.toxic), self._compressor(held.ordinary))
        self._unknown, self._number, *_ = [self._seen.sign(w) for w in (UNKNOWN, NUMBER, *held.known)]

    @staticmethod
    def _compressor(data: bytes):
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def distance(self, words: list[str]) -> int:
        """How many bytes the toxic dictionary saves over the ordinary one."""
        return self._seen["".join(map(self._seen.sign, words))]

    def _distances(self, signs: str) -> list[int]:
        """The distance of each window of a sentence."""
        seen = self._seen
        return [seen[signs[a:b]] for a, b in bounds(len(signs))]

    def furthest(self, words: list[str]) -> int:
        """The greatest distance over the windows of a sentence."""
        return max(self._distances("".join(map(self._seen.sign, words))))

    def judge(self, text: str | None) -> tuple[float, str | None]:
        """The highest score (0 to 1, one half at the threshold) over the windows of a text, and the words that have it."""
        words, begins = sentences(undisguise(text)) if text else ([], [])
        get, unknown, number = self._seen.signs.get, self._unknown, self._number
        marked = [get(w) or (number if w.isdigit() else unknown) for w in words]
        for i in begins[1:]:
            marked[i] = "\n" + marked[i]  # no word's sign
        signs = "".join(marked)
        while unknown * 2 in signs:  # as in tokens()
            signs = signs.replace(unknown * 2, unknown)
        best, where, far = -99, -1, []
        for i, line in enumerate(signs.split("\n") if words else ()):
            distances = self._distances(line)
            if (most := max(distances)) > best:
                best, where, far = most, i, distances
        if where < 0:
            return 0.0, None
        first, last = [*begins, len(words)][where : where + 2]
        at = [*_firsts("".join(marked[first:last]).strip("\n"), unknown), last - first]
        a, b = max(zip(far, bounds(len(at) - 1)))[1]
        return 1 / (1 + math.exp(-(best - self.held.threshold) / 4)), " ".join(words[first + at[a] : first + at[b]])


def _trained(plain: list[list[str]], toxic: list[list[str]], mixed: list[list[str]]) -> tuple[Scorer, list[list[str]], list[list[str]]]:
    """A scorer, and the toxic and ordinary sentences it was trained on.

    Toxic texts of several sentences mix both; a first pair of dictionaries, of sentences that are alone in their texts
    and of ordinary texts, tells which of them are toxic.
    """
    lexicon = [compressible(e) for e in _ENTRIES]

    def pair(ordinary: list[list[str]], bad: list[list[str]]) -> Scorer:
        return Scorer(Dictionaries(_train([*lexicon, *map(compressible, bad)]), _train(list(map(compressible, ordinary)))))

    first = pair(plain, toxic)
    bad = toxic + [w for w in mixed if first.distance(w) > 0]
    good = plain + [w for w in mixed if first.distance(w) <= 0]
    return pair(good, bad), bad, good


def fit(examples: list[tuple[str, str]]) -> Dictionaries:
    """The two dictionaries and the threshold, from judged ``(text, kind)``; ``none`` is ordinary.

    The threshold comes from ``FOLDS`` rounds in which the sentences of one part (equal ones stay together) are measured
    by dictionaries trained on the others.
    """
    known = known_words([t for t, _ in examples])
    split = [(k, [tokens(words[a:b], known) for words, begins in [sentences(undisguise(t))] for a, b in zip(begins, [*begins[1:], len(words)])]) for t, k in examples]
    plain = [w for k, ws in split if k == "none" for w in ws]
    toxic = [w for k, ws in split if k != "none" and len(ws) == 1 for w in ws]
    mixed = [w for k, ws in split if k != "none" and len(ws) > 1 for w in ws]
    scorer, bad, good = _trained(plain, toxic, mixed)

    def part(words: list[str]) -> int:
        return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) % FOLDS

    far: list[int] = []
    near: list[int] = []
    for fold in range(FOLDS if examples else 0):
        measure = _trained(*([w for w in side if part(w) != fold] for side in (plain, toxic, mixed)))[0]
        far += [measure.furthest(w) for w in bad if part(w) == fold]
        near += [measure.furthest(w) for w in good if part(w) == fold]
    return Dictionaries(scorer.held.toxic, scorer.held.ordinary, known, choose(far, near))


def choose(bad: list[int], good: list[int]) -> float:
    """Midway between what 9 of 10 toxic sentences reach and what 49 of 50 ordinary ones stay under, measured unseen."""
    least = sorted(bad)[len(bad) // 10] if bad else 0
    most = sorted(good)[len(good) * 49 // 50] if good else 0
    return (least + most) / 2


def fit_on(examples: DataFrame, most: int = MOST_EXAMPLES) -> Dictionaries:
    """Dictionaries from at most ``most`` judged texts (``text, kind``), taken in order of their text."""
    rows = examples.where(F.col("text").isNotNull()).select("text", F.coalesce("kind", F.lit("none")).alias("kind")).orderBy("text", "kind").limit(most)
    return fit([(r["text"], r["kind"]) for r in rows.toLocalIterator()])


def score_documents(documents: DataFrame, examples: DataFrame, most_examples: int = MOST_EXAMPLES) -> DataFrame:
    """``(doc_id, source, score, flagged, passage)`` of every document.

    Needs ``doc_id, source, text`` and judged ``text, kind``. Null, empty and blank texts score 0 and have no passage;
    repeated rows are scored each. Whole texts are read, window by window. Only the two dictionaries, bounded by
    ``most_examples``, are broadcast.
    """
    held = documents.sparkSession.sparkContext.broadcast(fit_on(examples, most_examples))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for b in batches:
            got = [scorer.judge(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": [g[0] for g in got], "flagged": [g[0] >= 0.5 for g in got], "passage": [g[1] for g in got]})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, score double, flagged boolean, passage string")


def abuse_rates(scored: DataFrame) -> DataFrame:
    """``(source, n_documents, n_flagged, share)`` over all documents of each source."""
    n = F.count_if("flagged")
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), n.alias("n_flagged"), F.round(n / F.count("*"), 6).alias("share"))
