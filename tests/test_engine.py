from __future__ import annotations

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from presswerk.config import SelectionRules
from presswerk.operators import briefs, graph, records, stories
from presswerk.sources import feeds
from presswerk.session import scratch_path
from presswerk.sources import registry
from presswerk.sources.store import ArticleStore, Deltas, load_or_compute, read_yaml
from presswerk.streaming.store import replay

SHORT = "row_id bigint, batch_no int, article_id string, url string, title string"


def test_first_wins_and_merge(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", "u1", "t"), (2, 0, "b", "u1", "t2"), (3, 0, "c", None, "t"), (4, 1, "c", None, "t4"), (5, 1, None, None, "t"), (6, 1, None, None, "t"), (7, 1, "z", "u1", "t7")], SHORT
    )
    assert sorted(r[0] for r in records.first_wins(rows).select("row_id").collect()) == [1, 3, 5, 6]
    kept = {(r.article_id, r.url, r.row_id) for r in records.merged(rows.where("batch_no = 0"), rows.where("batch_no = 1 AND article_id IS NOT NULL")).collect()}
    assert kept == {("a", "u1", 7), ("c", None, 4)}
    again = records.merged(records.merged(rows.limit(0), rows), rows)
    assert sorted(r.row_id for r in again.collect()) == sorted(r.row_id for r in records.merged(rows.limit(0), rows).collect())  # idempotent
    assert records.first_wins(rows.limit(0)).count() == 0


def test_stream_gives_what_one_merge_gives(spark):
    rows = spark.createDataFrame([(i, i % 3, f"id{i % 5}", f"u{i % 4}" if i % 2 else None, f"t{i}") for i in range(40)], SHORT).orderBy("batch_no")
    rows = rows.withColumn("row_id", F.col("batch_no") * 100 + F.col("row_id"))
    whole = records.merged(rows.limit(0), rows).select("article_id", "url", "row_id")
    assert sorted(map(str, replay(rows).select("article_id", "url", "row_id").collect())) == sorted(map(str, whole.collect()))


def test_a_store_opened_again_goes_on(spark):
    schema = spark.createDataFrame([], "row_id bigint, article_id string, url string, title string").schema
    path, rows = scratch_path(spark, "store"), [(i, f"a{i % 7}", f"u{i % 5}" if i % 3 else None, f"t{i}") for i in range(40)]
    for k in range(0, 40, 4):
        store = Deltas(spark, path, schema, compact_every=3)  # knows nothing but the folder
        store.merge(spark.createDataFrame(rows[k : k + 4], schema), f"batch-{k}")
        store.merge(spark.createDataFrame(rows[k : k + 4], schema), f"batch-{k}")  # the same once more
    whole = records.merged(spark.createDataFrame([], schema), spark.createDataFrame(rows, schema))
    held = Deltas(spark, path, schema)
    assert sorted(map(str, held.read().collect())) == sorted(map(str, whole.collect()))
    assert len(held._held()["parts"]) < 7  # parts were compacted
    held.merge(spark.createDataFrame(rows[:4], schema), "batch-0")  # compacted long ago: no change
    assert sorted(map(str, held.read().collect())) == sorted(map(str, whole.collect()))
    assert Deltas(spark, scratch_path(spark, "none"), schema).read().count() == 0


def test_recent_rows_and_pairs_read_every_written_time(spark, tmp_path):
    from presswerk.plans import core

    written = ["2024-05-20T10:00:00Z", "Mon, 20 May 2024 12:00:00 +0200", "2024-05-20", "1716199200", "just now", None, "2023-01-01T00:00:00Z", "20 May 2024 10:00:00"]
    rows = [(i, "s", "Banks raise lending rates again", w, "politics", None, f"a{i}") for i, w in enumerate(written)]
    fields = "row_id bigint, source string, title string, published_at string, category string, summary string, article_id string, final_content_for_ai string, content_for_ai string, content string, extracted_text string, raw_html string, url string"
    spark.createDataFrame([(*r, *[None] * 6) for r in rows], fields).write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([("s", "UTC", "dmy")], "name string, tz_name string, date_order string").write.parquet(f"{tmp_path}/sources.parquet")
    near = {0, 1, 2, 3, 7}
    assert {r.row_id for r in core.recent_rows(spark, str(tmp_path)).collect()} == near
    dated = sorted(near | {6})
    assert {(r.a, r.b) for r in core.title_pairs(spark, str(tmp_path)).collect()} == {(a, b) for a in near for b in near if a < b}
    places = {r.row_id: r.place for r in core.ordered_scan(spark, str(tmp_path)).collect()}
    assert len(places) == 8 and all(places[d] < places[u] for d in dated for u in (4, 5)) and places[6] == 6


def test_registers(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("sources:\n- {name: a, url: 'https://a.example/f', category: golf}\n- {name: b, url: 'https://b.example/i', category: golf, access_type: api}\n- {name: c, url: 'https://c.example', category: golf, access_type: rss_scrape, scrape_url: 'https://c.example/p', enabled: false}\n")
    got = {r.name: (r.enabled, r.source_access_tier, r.rss_url, r.api_url, r.scrape_url) for r in registry.load_sources(spark, tmp_path / "s.yaml").collect()}
    assert got == {"a": (True, "rss_plus_extract", "https://a.example/f", None, None), "b": (True, "api_fulltext", None, "https://b.example/i", None), "c": (False, "rss_plus_extract", "https://c.example", None, "https://c.example/p")}
    for bad in ("{name: a, url: '', category: g}", "{name: a, url: u, category: g, access_type: rss_scrape}", "{name: a, url: u, category: g, source_access_tier: api_fulltext}", "{name: a, url: u, category: g, access_type: api, source_access_tier: rss_only}", "{name: a, url: u, category: g, more: 1}", "{name: a, url: u, category: g, access_type: fax}"):
        (tmp_path / "bad.yaml").write_text(f"sources:\n- {bad}\n")
        with pytest.raises(ValueError):
            registry.load_sources(spark, tmp_path / "bad.yaml")
    traits = "{" + ", ".join(f"{t}: 3" for t in registry.TRAITS) + "}"
    one = "- {{profile_id: {}, profile_name: n, description: d, priority_sections: [market], traits: {}}}\n"
    (tmp_path / "p.yaml").write_text("active_profile: y\nprofiles:\n" + one.format("x", traits) + one.format("y", traits))
    profiles = registry.load_profiles(spark, tmp_path / "p.yaml")
    assert profiles.count() == 2 and registry.active_profile(profiles).first().profile_id == "y"
    for body in (f"active_profile: z\nprofiles:\n{one.format('x', traits)}", f"active_profile: x\nprofiles:\n{one.format('x', traits) * 2}", f"active_profile: x\nprofiles:\n{one.format('x', traits.replace('3', '9', 1))}"):
        (tmp_path / "q.yaml").write_text(body)
        with pytest.raises(ValueError):
            registry.load_profiles(spark, tmp_path / "q.yaml")
    (tmp_path / "r.yaml").write_text("brief_min_items: 2\nbrief_max_items: 5\nother: 1\n")
    rules = registry.load_rules(tmp_path / "r.yaml")
    assert (rules.least_items, rules.most_items) == (2, 5)
    (tmp_path / "r.yaml").write_text("brief_min_items: 6\nbrief_max_items: 5\n")
    with pytest.raises(ValueError):
        registry.load_rules(tmp_path / "r.yaml")
    assert registry.config_path(None, "NO_SUCH_VARIABLE", "d.yaml").name == "d.yaml" and registry.config_path("x", "HOME", "d").name == "x"


def test_quotas(spark):
    sources = spark.createDataFrame([(n, True, "rss", "rss_plus_extract") for n in "abc"] + [("d", False, "rss", "rss_plus_extract"), ("e", True, "scrape", "rss_plus_extract"), ("f", True, "rss", "rss_only")], "name string, enabled boolean, access_type string, source_access_tier string")
    assert {tuple(r) for r in records.fair_share(sources, 4, 8).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    rows = spark.createDataFrame([(i, s) for i, s in enumerate("aabbccff")], "row_id bigint, source string")
    tried = records.within_budget(rows, records.fair_share(sources, 3, 8)).where("attempt")
    assert sorted(r.source for r in tried.collect()) == ["a", "b", "c"]  # every source gets its share


def test_sections(spark):
    market = "Inflation and earnings move markets and stocks while the federal reserve holds rates."
    rows = spark.createDataFrame(
        [
            (1, "s", "politics", "Vote", "u", market),
            (2, "s", "business_markets", "Bonds", "u", market),
            (3, "s", "golf", "Open", "u", "plain"),
            (4, "s", "business_markets", "Price target raised", "u", market),
            (5, "s", "health_life", "Clinic", "u", market),
            (6, "s", None, None, None, None),
        ],
        "row_id bigint, source string, category string, title string, url string, summary string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("final_content_for_ai", "content_for_ai", "content", "editorial_tier")})
    assert [r.section for r in stories.section(rows).orderBy("row_id").collect()] == ["general", "market", "personal_interest", "general", "general", "general"]


def brute_groups(rows, rules):
    """Greedy growth that compares every row with every group."""
    groups, out = [], []
    for r in rows:
        best, top = None, 0.0
        for k, g in enumerate(groups):
            shared, ratio = len(g["w"] & set(r.words)), SequenceMatcher(None, r.title, g["title"]).ratio()
            body = len(g["b"] & set(r.body)) / len(g["b"] | set(r.body)) if g["b"] and r.body else 0
            names = len(g["n"] & set(r.names))
            title = shared >= 2 and ratio >= 0.9 and shared / len(g["w"] | set(r.words)) >= 0.34
            fits = abs(r.t - g["t"]) <= 72 * 3600 and ((title and (body >= 0.12 or names >= 1)) or (body >= 0.12 and names >= 1 and ratio >= 0.72 and shared >= 1))
            if fits and ratio + body + 0.2 * min(names, 3) > top:
                best, top = k, ratio + body + 0.2 * min(names, 3)
        if best is None:
            groups.append({"title": r.title, "w": set(r.words), "b": set(r.body), "n": set(r.names), "t": r.t})
            best = len(groups) - 1
        else:
            g = groups[best]
            g["t"], g["w"], g["b"], g["n"] = max(g["t"], r.t), g["w"] | set(r.words), g["b"] | set(r.body), g["n"] | set(r.names)
        out.append(best)
    return out


def test_groups_match_exhaustive_growth():
    rng = random.Random(7)
    words = ["rates", "rise", "fall", "bank", "vote", "storm", "deal", "north", "south"]
    rows = []
    for i in range(150):
        title = " ".join(rng.sample(words, 4))
        rows.append(SimpleNamespace(id=i, t=1e6 - i * 3000, title=title, words=title.split(), body=rng.sample("abcdefghij", 5), names=rng.sample(["X", "Y", "Z"], 1)))
    from presswerk.config import ClusterRules

    assert stories.grow_groups(rows) == brute_groups(rows, ClusterRules())


def test_one_publisher_two_feeds(spark):
    body = "Central bank officials in Ambercross said borrowing costs would stay where they are for the rest of the year. " * 2
    rows = spark.createDataFrame(
        [(1, "feed one", "Officials in Ambercross hold borrowing costs", "https://www.pub.example/a", body, "a1"), (2, "feed two", "Officials in Ambercross hold borrowing costs", "https://feeds.pub.example/b", body, "a2"), (3, "feed two", None, None, None, None)],
        "row_id bigint, source string, title string, url string, content string, article_id string",
    ).withColumns({"published": F.lit("2024-01-02 00:00:00").cast("timestamp"), "section": F.lit("general"), **{c: F.lit(None).cast("string") for c in ("summary", "final_content_for_ai", "content_for_ai")}})
    named = stories.clusters(rows).select("row_id", "cluster", "anchor")
    told = stories.candidates(rows.join(named, "row_id")).collect()
    assert [(t.source_count, t.feed_count, t.cluster_quality, t.publisher_domains) for t in told] == [(1, 2, "weak", ["pub.example"])]


def story(i, section, publisher, quality="moderate", sources=2, core=True):
    return Row(cluster_id=f"{section}{i:02}", section=section, primary_publisher=publisher, cluster_quality=quality, source_count=sources, core=core)


def test_choice_keeps_minimums_and_fills():
    ranked = [story(i, "general", "g") for i in range(15)] + [story(i, "market", "m") for i in range(5)] + [story(i, "personal_interest", "p") for i in range(2)]
    rules = SelectionRules(12, 20, 3, 2, section_minimums={"market": 4, "general": 10, "personal_interest": 1})
    ids = [c for c, _ in briefs.choose(ranked, rules)]
    assert 15 <= len(ids) <= 20 and len(set(ids)) == len(ids)
    assert sum(c.startswith("market") for c in ids) >= 4 and sum(c.startswith("general") for c in ids) >= 10
    only = briefs.choose([story(i, "general", f"p{i}") for i in range(4)], SelectionRules(4, 6, section_minimums={"market": 4, "general": 2}))
    assert len(only) == 4 and all(m == "primary" for _, m in only)
    weak = briefs.choose([story(1, "general", "a"), story(2, "general", "b", "weak", 1, False), story(3, "market", "c", "weak", 1, False)], SelectionRules(2, 6))
    assert [m for _, m in weak] == ["primary", "backfill"]
    assert briefs.choose([], rules) == []


def test_rules_are_checked():
    with pytest.raises(ValueError):
        SelectionRules(5, 3)
    assert SelectionRules(1, 5, section_minimums={"market": 4, "general": 4, "personal_interest": 1}).minimums() == {"market": 4, "general": 0, "personal_interest": 1}


def test_drafts(spark):
    told = "The Acme Corp board in Ambercross approved the merger plan. Shares rose after the vote."
    tales = spark.createDataFrame(
        [("c1", ["Acme Corp approves merger"], told, ["Acme Corp"], ["l1"], ["a1"], ["p.example"], ["s"], ["markets"], "market", 1, "weak")],
        "cluster_id string, representative_titles array<string>, candidate_text string, primary_entities array<string>, source_links array<string>, article_ids array<string>, publisher_domains array<string>, source_names array<string>, story_tags array<string>, section string, source_count int, cluster_quality string",
    )
    drafts = spark.createDataFrame(
        [
            (1, [" c1 ", "c1", "", "nope"], "Acme Corp approves merger", "The board approved the merger plan. Shares rose after the vote.", "It matters for shares."),
            (2, ["c1"], "Zeta Holdings approves merger", "The board approved the merger plan. Shares rose after the vote.", "It matters."),
            (3, ["c1"], "Short", "One sentence only.", None),
            (4, [], None, None, None),
        ],
        "draft_id bigint, cluster_ids array<string>, headline string, summary string, why_it_matters string",
    )
    resolved = briefs.resolved_drafts(drafts.select("draft_id", "cluster_ids"), tales)
    judged = {r.draft_id: (r.grounded, r.unsupported) for r in briefs.grounded(drafts, resolved).collect()}
    assert judged[1][0] and not judged[2][0] and judged[2][1] == 1
    assert [r[0] for r in drafts.orderBy("draft_id").select(briefs.is_well_formed()).collect()] == [True, True, False, False]
    assert [tuple(r) for r in briefs.accept_drafts(drafts, tales).collect()] == [(1, 1, ["c1"])]
    assert briefs.joined_items(resolved).where("draft_id = 1").first().primary_publisher == "p.example"


def test_profile_score_and_output(spark):
    traits = {t: 4 for t in ("calmness", "skepticism", "optimism", "urgency_sensitivity", "novelty_appetite", "macro_orientation", "market_focus", "contrarian_appetite", "personal_interest_weight", "signal_to_noise_strictness")}
    profiles = spark.createDataFrame([("p", ["golf", ""], ["general"], traits)], "profile_id string, interests array<string>, priority_sections array<string>, traits struct<" + ",".join(f"{t}:int" for t in traits) + ">")
    items = spark.createDataFrame([("c1", "market", "Golf now", "x", "low", 1, 1, ["https://a.b"], "weak"), ("c2", "general", "Plain", "", "high", 3, 1, [], "strong")], "cluster_id string, section string, headline string, summary string, confidence string, source_count int, feed_count int, source_links array<string>, cluster_quality string")
    rows = briefs.scored(items, profiles, F.concat_ws(" ", "headline", "summary"), F.length("summary"))
    got = {r.cluster_id: (round(r.score, 6), r.reasons) for r in rows.collect()}
    assert got["c1"] == (round(1.8 * 4 + 0.9 * 4 + 0.7 * 4 + 0.4 * 4 - 0.55 * 4, 6), ["interest_hits=1", "market_section_boost", "urgency_hits=1", "low_confidence_penalty"])
    placed = briefs.ordered_items(rows)
    assert [r.cluster_id for r in placed.orderBy("place").collect()] == ["c2", "c1"]
    page = briefs.brief_markdown(placed.withColumn("why_it_matters", F.lit("so")))
    assert "- **Golf now** (`low` | sources=1 | quality=weak)" in page and "## Personal Interest\n- No items." in page
    assert briefs.payload(placed.limit(0).withColumn("why_it_matters", F.lit("so"))).count() == 3
    assert briefs.counts(items).first().asDict() == {"final_items": 2, "market": 1, "general": 1, "personal_interest": 0}
    assert briefs.macro_theme(items, F.col("headline")) is None and briefs.interest_focus(items, F.col("headline"), ["Golf"]) == "golf"


def test_enrichment_by_tier(spark):
    page = "<article><p>" + "A paragraph that is certainly longer than forty characters. " * 9 + "</p></article>"
    rows = spark.createDataFrame(
        [(1, "u1", None, "rss_plus_extract"), (2, "u2", None, "rss_plus_extract"), (3, "u1", None, "rss_only"), (4, None, "short", "api_fulltext"), (5, None, None, "api_fulltext"), (6, "u1", None, "blocked_or_paywalled"), (7, "u3", None, "rss_plus_extract"), (8, None, None, None)],
        "row_id bigint, url string, content string, source_access_tier string",
    )
    pages = spark.createDataFrame([("u1", page, "ok"), ("u3", None, "blocked")], "url string, page string, status string")
    got = {r.row_id: (r.extraction_status, r.extraction_method) for r in records.enriched(rows, pages).collect()}
    assert got == {
        1: ("ok", "readability"), 2: ("failed", "none"), 3: ("skipped", "none"), 4: ("partial", "api_payload"), 5: ("failed", "none"), 6: ("blocked", "none"), 7: ("blocked", "none"), 8: ("failed", "none"),
    }
    spent = records.enriched(rows.withColumn("attempt", F.lit(False)), pages).where("row_id = 1").first()
    assert spent.extraction_status == "skipped"


def test_items_notes_and_intro(spark):
    tales = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["b"]), ("c3", ["z", None])], "cluster_id string, article_ids array<string>")
    items = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["b", "q"]), (3, []), (4, None)], "item_id bigint, article_ids array<string>")
    assert {tuple(r) for r in briefs.stories_of_items(items, tales).collect()} == {(1, "c1", 2, True), (2, "c1", 1, False), (2, "c2", 1, False)}
    one = spark.createDataFrame([("Stop! Now", "high", 1)], "t string, c string, h int")
    traits = {t: F.lit(4) for t in ("calmness", "skepticism", "urgency_sensitivity", "novelty_appetite", "macro_orientation", "contrarian_appetite")} | {"signal_to_noise_strictness": F.lit(3)}
    told = one.select(briefs.noted(F.col("t"), F.col("c"), {"urgency": F.col("h"), "novelty": F.lit(0)}, traits, {"high": "Sure.", "urgency": "Soon.", "novelty": "New."})).first()[0]
    assert told == "Stop. Now. Sure. Soon."
    assert briefs.intro_fits("Golf and inflation lead today.", "golf", "inflation")
    assert not briefs.intro_fits("Golf leads. More follows.", None, None) and not briefs.intro_fits("Golf leads.", None, "CPI") and not briefs.intro_fits("", None, None)
    tries = []
    assert feeds.with_retries(lambda u: tries.append(u) or (len(tries) > 1 or 1 / 0), 1)("x") is True


def test_graph(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5)], "a bigint, b bigint")
    roots = {r.id: r.root for r in graph.components(links).collect()}
    assert all(roots[i] == 1 for i in range(1, 61)) and roots[101] == 100
    assert graph.components(links.limit(0)).count() == 0
    posts = spark.createDataFrame([(k, i) for k in range(3) for i in range(40)] + [(9, 1)], "key bigint, id bigint")
    pairs = graph.pairs_sharing_keys(posts, block=7)  # every list is hot
    assert pairs.count() == 40 * 39 // 2 and pairs.where("shared != 3").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>One</title><link>HTTPS://X.example/a</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>d</description></item><item><link>https://x.example/b</link></item></channel></rss>")
    (tmp_path / "api.json").write_text('{"results": [{"headline": "Two", "id": "https://x.example/c", "body": "text"}]}')
    (tmp_path / "list.json").write_text('[{"title": "Three", "url": "https://x.example/d"}]')
    rows, status = feeds.scan_sources(
        spark,
        [{"name": "f", "access_type": "rss", "category": "golf"}, {"name": "a", "access_type": "api"}, {"name": "off", "enabled": False}, {"name": "bad", "access_type": "broken"}, {"name": "late", "access_type": "late"}],
        {"rss": lambda s: feeds.read_rss(spark, str(tmp_path / "feed.xml")), "api": lambda s: feeds.read_api(spark, str(tmp_path / "*.json")), "broken": lambda s: 1 / 0, "late": lambda s: spark.range(1).selectExpr("raise_error('unreadable') AS title")},
        "2024-01-02T00:00:00Z",
    )
    got = {(r.source, r.title, r.url, r.discovery_quality) for r in rows.collect()}
    assert got == {("f", "One", "https://x.example/a", "full_metadata"), ("f", "(untitled)", "https://x.example/b", "partial_metadata"), ("a", "Two", "https://x.example/c", "partial_metadata"), ("a", "Three", "https://x.example/d", "partial_metadata")}
    assert [s["status"] for s in status] == ["ok", "ok", "skipped", "failed", "failed"]
    store = ArticleStore(spark, str(tmp_path / "store"))
    store.upsert(rows)
    store.upsert(rows)
    assert store.count() == 4
    pages = feeds.fetch_pages(rows, lambda u: ("<p>x</p>", "ok") if u.endswith("a") else 1 / 0)
    assert sorted(r.status for r in pages.collect()) == ["failed", "failed", "failed", "ok"]
    made = tmp_path / "o" / "r.json"
    assert load_or_compute(made, lambda: {"items": []}) == {"items": []} and load_or_compute(made, lambda: 1 / 0) == {"items": []}
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert read_yaml(tmp_path / "c.yaml") == {"a": 1}


def test_stories_read_every_written_time(spark, tmp_path):
    from presswerk.plans import core

    text = "source, article_id, category, discovery_quality, title, url, published_at, summary, content, raw_html, extracted_text, final_content_for_ai, content_for_ai, editorial_tier".split(", ")
    times = ["2024-03-01T12:00:00Z", "2024-03-01T12:00:00.250+02:00", "Fri, 01 Mar 2024 09:00:00 GMT", "2024-03-02", "1 March 2024 08:00", None, "soon"]
    rows = [(i, 0, *({"source": "s", "article_id": f"a{i}", "url": f"https://x.example/{i}", "title": "Harbour bridge opens again", "published_at": t}.get(c) for c in text)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "row_id bigint, batch_no int, " + ", ".join(f"{c} string" for c in text)).write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([("s", "Europe/Berlin", "dmy")], "name string, tz_name string, date_order string").write.parquet(f"{tmp_path}/sources.parquet")
    got = {(r.a, r.b) for r in core.similar_titles(spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in range(5) for b in range(a + 1, 5)}
    assert {r.row_id for r in core.story_clusters(spark, str(tmp_path)).collect()} == set(range(5))


def test_short_titles_that_share_one_word_make_a_story(spark):
    body = "Elin Oxby of Pell Harbour said lenders in Millford moved their charges after the meeting in Tarn Valley on Monday."
    titles = ["Banks raise lending rates", "Bank raises lending rate", "Storm closes the northern port", "Storm closed a northern port"]
    rows = [(i, t, f"2024-01-02 0{9 - i}:00:00", body) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "row_id bigint, title string, at string, content string").withColumns({"published": F.to_timestamp("at"), "section": F.lit("general"), "content_for_ai": F.col("content"), **{c: F.lit(None).cast("string") for c in ("summary", "final_content_for_ai", "extracted_text")}})
    assert {r.row_id: r.cluster for r in stories.clusters(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
