from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from presswerk.llm.boilerplate import boilerplate_lines, main_bodies, main_text, page_lines
from presswerk.llm.repeated_lines import line_templates, merged_templates, repeated_lines, repeated_templates, without_repeated_lines
from presswerk.llm.residue import assess, host_of, is_placeholder, residue_rows, unfilled
from presswerk.llm.text import line_key
from presswerk.llm.truncation import ending, judge_values, source_limits, storage_limits, truncation_rates
from presswerk.session import stage

BODY = "The council of Ambercross approved the budget after a long debate on Monday."
PAGE = "row_id bigint, source string, title string, url string, summary string, content_for_ai string, extracted_text string, raw_html string, extra string"


def rows_of(spark, rows):
    """Rows from dicts; missing columns are null."""
    names = [x.split()[0] for x in PAGE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PAGE)


def test_page_lines():
    text = "\n".join(
        [
            "Home", "Markets", "Sport | Golf | Video | Jobs", "We use cookies to improve this site. Accept all",  # 1-4
            "Council approves budget", "By the Corven newsroom", BODY, "", "What the council does next", BODY, "- Tarn Energy: 5.5 percent",  # 5-11
            "Advertisement", BODY, "Photo: Ines Oxby in Tarn", "A cookie notice at the firm drew complaints, and it promised a shorter one.",  # 12-15
            "Most read", "Mayor of Tarn leaves office after vote", "Otters beat Kites 3-1 in Millshore", "© 2024 Corven Media. All rights reserved.", "Editor's note: an earlier version was shorter.",  # 16-20
        ]
    )
    assert page_lines(text, "Council approves budget") == [1, 2, 3, 4, 12, 16, 17, 18, 19]
    assert page_lines(None) == page_lines("") == [] and page_lines("\n \n") == []
    linked = "<nav><a href='x'>An odd teaser of another story here</a></nav><p>text</p>"
    assert page_lines(f"{BODY}\nAn odd teaser of another story here\n{BODY}", None, linked) == [2]
    assert main_text(f"{BODY}\nAdvertisement\n{BODY}") == f"{BODY}\n{BODY}"
    assert page_lines("x" * 200_000 + ".") == []


def test_densities_decide(monkeypatch):
    from presswerk.llm import boilerplate

    consent = "This site and its partners use cookies and similar techniques. Cookie settings can be changed at any time. Use of cookies helps us to measure how the pages are read. " * 3
    assert page_lines(f"{BODY}\n{consent}\n{BODY}") == [2]  # furniture at any length
    teaser = "The mayor says what happened to the bridge, and why it was closed."
    page = f"<div><p>{BODY}</p><p><a href='/x'>{teaser}</a></p></div>"
    assert page_lines(f"{BODY}\n{teaser}", None, page) == [2] and page_lines(f"{BODY}\n{teaser}") == []
    lead = "Ardan Tellis Morwen Castrel"
    text = f"{lead}, Ilmar Oxby Selwyn Dravane.\nMenu\nSearch"
    assert page_lines(text) == [1, 2, 3] and page_lines(text.replace("Ilmar", "as the")) == [2, 3]  # no prose without stop words
    boilerplate.decide.cache_clear()
    monkeypatch.setattr(boilerplate, "STOPWORDS", frozenset())
    assert page_lines(f"Menu\n{teaser}\nSearch") == [1, 2, 3]
    boilerplate.decide.cache_clear()


def test_boilerplate_operator(spark):
    rows = rows_of(spark, [{"row_id": 1, "extracted_text": f"{BODY}\r\nAdvertisement\r"}, {"row_id": 2}, {"extracted_text": f"{BODY}\nAdvertisement"}, {"row_id": 3, "extracted_text": ""}, {"row_id": 1, "extracted_text": f"{BODY}\nAdvertisement"}])
    assert [tuple(r) for r in boilerplate_lines(rows).collect()] == [(1, 2), (1, 2)]
    assert boilerplate_lines(rows.limit(0)).count() == 0
    assert sorted((r.row_id or 0, r.text) for r in main_bodies(rows).where("text IS NOT NULL").collect()) == [(0, BODY), (1, BODY), (1, BODY + "\r"), (3, "")]
    assert main_bodies(rows).where("text IS NULL").count() == 1


def test_repeated_lines_match_counting(spark):
    rows = [{"row_id": i, "source": s, "extracted_text": f"Share {i} times\n  SHARE  {i + 1}  times \nstory {chr(97 + i % 26)} of {s}\n\n{'rare' if i < 4 else 'x' * i}"} for i, s in enumerate(["a"] * 60 + ["b"] * 4 + [None] * 6)]
    rows.append({"row_id": 99, "source": "a"})
    rows.append({"row_id": None, "source": "c", "extracted_text": "x"})
    df = rows_of(spark, rows)
    found = {tuple(r) for r in repeated_lines(df, 5, 0.02).collect()}
    docs, totals = defaultdict(Counter), Counter()
    for r in rows:
        if r.get("extracted_text") is not None:
            totals[r["source"]] += 1
            docs[r["source"]].update({line_key(x) for x in r["extracted_text"].split("\n")} - {""})
    want = set()
    for r in rows[:-1]:
        for n, x in enumerate((r.get("extracted_text") or "").split("\n"), 1):
            c = docs[r["source"]][line_key(x)]
            if line_key(x) and c >= 5 and c >= 0.02 * totals[r["source"]]:
                want.add((r["row_id"], n))
    assert found == want and (0, 1) in found and (0, 2) in found
    cleaned = {r.row_id: r.text for r in without_repeated_lines(df).collect()}
    assert "Share" not in cleaned[0] and cleaned[99] is None
    assert repeated_templates(df.limit(0)).count() == 0


def test_templates_have_slots_for_names(spark, monkeypatch):
    names = "Ardan Morwen Selwyn Ilmar Castrel Tellis Brenna".split()
    rows = [{"row_id": i, "source": "s", "extracted_text": f"Written for the Tarn Wire by {n} in the old town\nStory {n} of {names[i - 1]} alone {i}\n {n} reports for us daily \n\nUpdated at {i}:3{i} today"} for i, n in enumerate(names)]
    rows += [{"row_id": 50, "source": "s"}, {"row_id": 51, "source": None, "extracted_text": "Written for the Tarn Wire by Ardan in the old town"}]
    df = rows_of(spark, rows)
    want = {("s", "written for the tarn wire by * in the old town", 7), ("s", "updated at 0:0 today", 7), ("s", "story * of * alone 0", 7)}
    assert {tuple(r) for r in line_templates(df).collect()} == want
    from presswerk.llm import repeated_lines as module

    monkeypatch.setattr(module, "LEAF", 2)  # parts of leaves are merged as trees
    assert {tuple(r) for r in line_templates(df).collect()} == want
    assert line_templates(df.limit(0)).count() == 0
    assert merged_templates([("a b c d x", 1), ("a b c d y", 3), ("a b c d z", 2), ("p q r s t", 1)], 0.6) == [("a b c d *", 6), ("p q r s t", 1)]
    assert merged_templates([("a * * d", 2), ("a b c d", 1)], 0.6) == [("a * * d", 2), ("a b c d", 1)]  # slots agree with nothing


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("404 Not Found\nThe page you are looking for has moved.\nReference 7f3a", True),
        ("Please enable JavaScript to view this page.", True),
        ("Fehler 404: Die gesuchte Seite wurde nicht gefunden.", True),
        (f"Checking your browser before you continue. Ray ID 3f\n{BODY}", True),
        ('{"error":{"code":142,"message":"upstream timed out"}}', True),
        ("xxxxx xxxxx xxxxx\nHeadline placeholder, two lines max", True),
        ("Solunt sorit dantis mintas noriat ulva campil noriat lumena tevor.\nDestor tevor dantis prindi ulva ebris marcida noriat.", True),
        (f"{BODY} Shares moved {{{{headline}}}} on Friday.", True),
        (f"{BODY} It fell NaN percent on Friday.", True),
        (f"{BODY} The [Company Name] board met.", True),
        (f"{BODY}\nThe tutorial shows how <code>{{{{ user.name }}}}</code> is filled in by the server.", False),
        (f"{BODY}\nThe string [object Object] on a billboard amused the mayor.", False),
        (f"{BODY}\nVisitors met a 404 page, and the phrase “page not found” became a joke.", False),
        (f"{BODY}\nThe outage, logged as 503 Service Unavailable by the firm, cost a lot in fares.", False),
        (BODY, False),
        ("", False),
        (BODY + " x" * 100_000, False),
    ],
)
def test_residue_of_one_text(text, bad):
    assert assess(text, "A headline", None)[0] is bad


def test_residue_by_host_evidence(spark):
    rows = [{"row_id": i, "title": f"{w} story {w}x", "extracted_text": f"Our robots could not open number {i}00f."} for i, w in enumerate(["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"])]
    rows += [{"row_id": 50, "title": "robots story", "extracted_text": "Our robots could not open number 500f."}, {"row_id": 60}, {"row_id": 70, "extracted_text": " "}, {"row_id": 80, "title": None, "extracted_text": "404 Not Found"}, {"row_id": None, "extracted_text": "404 Not Found"}]
    df = rows_of(spark, rows)
    # the row whose headline is about it is an article; five other headlines make the rest a response
    assert sorted(r.row_id for r in residue_rows(df).collect()) == [0, 1, 2, 3, 4, 5, 80]
    assert residue_rows(df.limit(0)).count() == 0
    # another site's one such row, or six sites with one each, are no evidence
    apart = [dict(r, source=f"s{r['row_id']}", url=f"https://h{r['row_id']}.example/x") for r in rows[:6]]
    assert residue_rows(rows_of(spark, apart)).count() == 0
    joint = [dict(r, url="https://www.same.example/x") for r in apart]
    assert residue_rows(rows_of(spark, joint)).count() == 6  # by host, whatever the source
    assert host_of("https://user@www.Tarn.example:80/a") == host_of("//tarn.example") == "tarn.example" and host_of("x") is host_of(None) is None
    long = f"{BODY} " + "The council met again that week. " * 30
    strange = [dict(r, extracted_text=f"Our robots could not open this page, and it is their fault alone.\n{long}") for r in rows[:6]]
    assert residue_rows(rows_of(spark, strange)).count() == 6  # at any length
    assert is_placeholder("{{title}}") and is_placeholder("Untitled document") and not is_placeholder("A headline")
    assert not unfilled("a < b and [see note] {x}")


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (f"{BODY} The mayor sa", "cut"),
        (f"{BODY} The mayor… [+1226 chars]", "cut"),
        (f"{BODY} The [...]", "cut"),
        (f"{BODY} The… Read more", "cut"),
        (f"{BODY} The mayor &quo", "cut"),
        (f"{BODY} The mayor �", "cut"),
        (f"{BODY} The mayor</b", "cut"),
        (f"{BODY} And then came the silence...", "ellipsis"),
        (BODY, "ended"),
        (f"{BODY} “It is over.”", "ended"),
        (f"{BODY} Photos: Ines Oxby", "part"),
        (f"{BODY} Contact: desk@tarn.example", "part"),
        (f"{BODY} #Tarn #Golf", "part"),
        (f"{BODY} “No comment,” said Noor Oxby", "part"),
        (f"{BODY} - Tarn Energy: 5.5 percent", "part"),
        (f"{BODY} - Tarn Energy: 5.", "cut"),
        ("Council approves budget", "headline"),
        ("Another headline of a row", "open_headline"),
        ("  ", "blank"),
    ],
)
def test_endings(value, want):
    assert ending(value, "Council approves budget") == want


def test_fuller_text_settles_an_ending():
    assert ending(f"{BODY} Photos: Ines Ox", None, f"{BODY}\nPhotos: Ines Oxby") == "cut"
    assert ending("It cost 3.", None, "It cost 3.5 million. Then") == "cut"
    assert ending("It cost 3.", None, "It cost 3. Then") == "ended"


def test_truncation_operator(spark):
    rows = [{"row_id": i, "source": "s", "title": "Council approves budget", "summary": (f"{BODY} The mayor {'said so ' * 20}" + "abcdefgh"[i])[:150]} for i in range(8)]
    limit = len(rows[0]["summary"])
    closing = f"{BODY} #Tarn "
    rows.append({"row_id": 20, "source": "s", "summary": closing + "#" + "g" * (limit - len(closing) - 1)})  # a tag that ends at the limit
    rows.append({"row_id": 21, "source": "s", "summary": f"{BODY} #Tarn #Golf"})
    rows.append({"row_id": 22, "source": "s", "summary": f"{BODY} And then came the silence...", "extracted_text": f"{BODY}\nAnd then came the silence..."})
    rows.append({"row_id": 23, "source": "s", "summary": f"{BODY} The lights went..."})
    rows.append({"row_id": 24, "source": "t", "content_for_ai": "404 Not Found nginx", "extracted_text": "404 Not Found\nnginx"})
    rows.append({"row_id": 25, "source": "t", "summary": "Council approves budget", "content_for_ai": ""})
    df = rows_of(spark, rows)
    judged = stage(judge_values(df), "judged")
    cut = sorted((r.row_id, r.field) for r in judged.where("cut").collect())
    assert cut == sorted([(i, "summary") for i in range(8)] + [(20, "summary"), (23, "summary")])
    assert judged.count() == 8 + 4 + 1 + 2
    rates = {r.source: (r.n_values, r.n_cut) for r in truncation_rates(judged).collect()}
    assert rates == {"s": (12, 10), "t": (3, 0)}
    assert judge_values(df.limit(0)).count() == 0
    assert storage_limits(spark.createDataFrame([], "field string, source string, ending string, lengths array<int>")).count() == 0


def test_limits_raise_and_confirm_cuts(spark, monkeypatch):
    from presswerk.llm import truncation

    rows = [{"row_id": i, "source": "s", "summary": (f"{BODY} The mayor {'said so ' * 20}" + "abcdefgh"[i])[:150]} for i in range(8)]
    limit = len(rows[0]["summary"])
    told = f"{BODY} Then the envoy of the U.S. spoke to them all."
    pad = limit - len(told.split(" spoke")[0])
    full = ("x" * (pad - 1) + " " if pad > 0 else "") + told
    rows.append({"row_id": 30, "source": "s", "summary": full[: full.index(" spoke")], "extracted_text": full})  # a point inside a sentence, at the limit
    rows.append({"row_id": 31, "source": "t", "summary": full[: full.index(" spoke")], "extracted_text": full})  # the same where no limit is
    thought = f"{BODY} And so it went on and on"
    dots = thought + "." * 3 if len(thought) + 3 == limit else (thought + "n" * (limit - len(thought) - 3) + "...")
    rows.append({"row_id": 32, "source": "s", "summary": dots, "extracted_text": dots})  # writers end so, but not at a limit
    df = rows_of(spark, rows)
    cut = {r.row_id for r in judge_values(df).where("cut").collect()}
    assert {30, 32} <= cut and 31 not in cut
    found = {(r.source, r.measure, r.length) for r in source_limits(df).collect()}
    assert ("s", "chars", limit) in found and not any(s == "t" for s, _, _ in found)
    none = storage_limits(spark.createDataFrame([], "field string, source string, ending string, lengths array<int>"))
    monkeypatch.setattr(truncation, "storage_limits", lambda measured: none)
    assert cut - {r.row_id for r in judge_values(df).where("cut").collect()} == {30, 32}  # without limits
