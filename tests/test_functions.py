from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from presswerk.functions import markup, text, urls

TEXTS = [
    "  Breaking news:\tThe NASA and New York Times agree. It works well! The end of the. ",
    "&lt;b&gt;Bold&lt;/b&gt; claim &amp; more",
    "Élan vital – café déjà vu",
    "",
    None,
    "one",
    "x" * 300 + " and",
]


def col(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select(expression.alias("v"), "i").orderBy("i").collect()]


def test_cleaning(spark):
    want = [" ".join(re.sub("<[^>]+>", " ", html.unescape(v)).split()) or None if v is not None else None for v in TEXTS]
    assert col(spark, TEXTS, text.normal_text("t")) == want
    assert col(spark, TEXTS, text.collapse("t")) == [(" ".join(v.split()) or None) if v is not None else None for v in TEXTS]
    assert col(spark, [" a b ", " "], text.strip("t")) == ["a b", None]
    assert col(spark, TEXTS, text.normal_title("t"))[2] == "élan vital café déjà vu"


def test_sentences(spark):
    assert col(spark, TEXTS, text.sentence_count("t")) == [3, 1, 1, 0, 0, 1, 1]
    assert col(spark, ["a", "a!", " ", None], text.ensure_sentence("t")) == ["a.", "a!", "", ""]
    assert col(spark, ["It is the.", "Fine here.", "Wait...", "so:", None], text.looks_truncated("t")) == [True, False, True, True, True]
    assert col(spark, ["This is a whole sentence.", "This goes to", "Hi."], text.is_whole_sentence("t")) == [True, False, False]
    assert col(spark, ["First is fine here. first IS fine here. Second is fine too.", "Only one here."], text.clean_summary("t")) == ["First is fine here. Second is fine too.", None]
    assert col(spark, ["one two three four", "one two"], text.first_words("t", 3)) == ["one two three.", "one two"]
    long = col(spark, TEXTS[6:], text.short_sentence("t"))[0]
    assert len(long) <= 241 and long.endswith(".")
    assert col(spark, ["It went to the", "b", "a", None, ""], text.short_sentence("t")) == ["It went to.", "b.", "", "", ""]
    assert col(spark, ["One two " * 40], text.short_sentence("t"))[0] == "One two " * 29 + "One."


def test_words_and_names(spark):
    assert col(spark, ["Latest update: the Fed cuts 25 rates", "ab cd"], text.title_words("t")) == [["the", "fed", "cuts", "rates"], ["ab", "cd"]]
    assert col(spark, ["NASA met NASA and The New York Times, Fox"], text.entities("t")) == [["NASA", "The New York", "Times"]]
    assert col(spark, ["The Fed met Acme Corp"], text.mentions("t")) == [["the fed", "acme corp"]]
    assert col(spark, ["federal said", None], text.keyword_hits("t", ["fed", "ai", "fed"])) == [2, 0]
    assert col(spark, ["Best DEAL", None], text.contains_any("t", ["deal", " "])) == [True, False]
    assert col(spark, ["yes", "0", "7", "maybe", None], text.as_bool("t", True)) == [True, False, True, True, True]
    pairs = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    got = [r[0] for r in pairs.select(text.matching_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in (("tide", "diet"), ("diet", "tide"), ("", "x"))]


def test_addresses(spark):
    raw = ["HTTPS://www.Foo.co.uk/a;p?b=2&a=1&c=#x", "//Foo.com", "foo bar", "", None, "http://u:p@m.example:80/"]
    assert col(spark, raw, urls.canonical_url("t")) == ["https://www.foo.co.uk/a?a=1&b=2&c=", "https://foo.com/", "foo bar", None, None, "http://u:p@m.example:80/"]
    assert col(spark, raw, urls.publisher("t")) == ["foo.co.uk", "foo.com", "unknown", "unknown", "unknown", "m.example"]
    fronts = ["https://x.com", "https://x.com/news/", "https://x.com/news/us", "https://x.com/a/latest", "https://x.com/p.jpg", "https://x.com/news/story-1", "https://x.com/a/b/c"]
    assert col(spark, fronts, urls.is_section_front("t")) == [True, True, True, True, True, False, False]
    ads = ["https://x.com/?utm_a=1", "https://x.com/?iid", "https://x.com/?q=" + "revshare" * 6, "https://x.com/?q=1", "https://x.com/"]
    assert col(spark, ads, urls.is_ad_tracking("t")) == [True, True, True, False, False]
    links = spark.createDataFrame([(["https://a.b/c", "article:1"],)], "l array<string>")
    assert links.select(urls.source_links("l")).first()[0] == "[source 1](https://a.b/c), `article:1`"


def test_markup(spark):
    para = "A paragraph that is certainly longer than forty characters."
    page = f"<nav><p>{para} in nav</p></nav><article><p>{para}</p><p>{para.upper()}</p><p>short</p></article><div class='x'><p>{para} twice longer text outside</p></div>"
    got = col(spark, [page, "<p>no</p>", None, f"<p>{para} &amp; so</p>"], markup.extracted("t", 50))
    assert (got[0]["text"], got[0]["status"], got[0]["method"]) == (para, "ok", "readability")
    assert [(g["status"], g["method"]) for g in got[1:]] == [("failed", "none"), ("failed", "none"), ("ok", "paragraph_fallback")]
    assert got[3]["text"] == para + " & so"
    assert col(spark, [page], F.size(markup.paragraphs(markup.without_noise("t")))) == [2]
