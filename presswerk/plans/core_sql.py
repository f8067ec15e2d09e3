"""The same results in SQL, written apart from the operators, for those that SQL can express."""

from __future__ import annotations

from presswerk.config import SIGNALS, TAGS, WEIGHTS, Vocabulary
from presswerk.functions.text import GENERIC_TITLE_WORDS, STOPWORDS
from presswerk.functions.urls import AD_KEYS, FRONT_LAST, FRONT_SEGMENTS, MEDIA, SECOND_LEVEL


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _hits(words, text: str) -> str:
    return f"len(list_filter({_list(dict.fromkeys(words))}, lambda k: contains({text}, k)))"


W = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"
CANON = r"'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$'"
NORM = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))"
V = Vocabulary()

SECTIONS = f"""
SELECT row_id, source, article_id, CASE WHEN personal THEN 'personal_interest' WHEN passes AND NOT plain THEN 'market' ELSE 'general' END AS section FROM (
 SELECT *, CASE WHEN category IN {_in(V.market_categories)} AND category = 'business_markets' THEN signal
                WHEN category IN {_in(V.market_categories)} THEN macro
                ELSE category NOT IN {_in(V.blocked_categories)} AND (signal OR macro) END AS passes FROM (
  SELECT *, m >= {V.least_market} AND h >= {V.least_high} AND m >= o + {V.margin} AS signal, c >= {V.least_macro} AND h >= {V.least_high} AND o = 0 AS macro FROM (
   SELECT row_id, source, article_id, trim(coalesce(category, '')) AS category,
     trim(coalesce(category, '')) IN {_in(("golf", *V.personal_categories))} OR {_hits(V.personal_marks, "hay")} > 0 OR coalesce(editorial_tier, '') = 'personal_radar' AS personal,
     {_hits(V.excluded_titles, "lower(title)")} > 0 AS plain,
     {_hits(V.market, "t")} AS m, {_hits(V.high_signal, "t")} AS h, {_hits(V.macro, "t")} AS c, {_hits(V.other, "t")} AS o
   FROM (SELECT *, lower(concat_ws(' ', trim(source), trim(regexp_replace(title, '{W}', ' ', 'g')), url)) AS hay,
     lower(trim(regexp_replace(concat_ws(' ', title, summary, coalesce(final_content_for_ai, content_for_ai), content), '{W}', ' ', 'g'))) AS t FROM articles))))"""

WORDS = f"""(SELECT *, CASE WHEN len(w1) > 0 THEN w1 ELSE w2 END AS words FROM (
  SELECT *, list_filter(w, lambda x: length(x) >= 3 AND x NOT IN {_in([*STOPWORDS, *GENERIC_TITLE_WORDS])} AND NOT regexp_full_match(x, '\\p{{Nd}}+')) AS w1,
         list_filter(w, lambda x: length(x) >= 2 AND x NOT IN {_in(GENERIC_TITLE_WORDS)} AND NOT regexp_full_match(x, '\\p{{Nd}}+')) AS w2
  FROM (SELECT *, {NORM} AS title_norm, list_distinct(string_split({NORM}, ' ')) AS w FROM articles)))"""

RANK = "CASE cluster_quality WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, source_count DESC, len(article_ids) DESC, CASE section WHEN 'market' THEN 0 WHEN 'general' THEN 1 WHEN 'personal_interest' THEN 2 ELSE 3 END, cluster_id"
TOLD = "lower(concat_ws(' ', array_to_string(representative_titles, ' '), candidate_text))"
CONFIDENCE = "CASE WHEN {0} >= 3 THEN 'high' WHEN {0} = 2 THEN 'medium' ELSE 'low' END"
RESOLVED = """(SELECT r.draft_id, CAST(r.position AS INTEGER) AS position, c.* FROM (
  SELECT draft_id, trim(raw) AS cid, min(i - 1) AS position FROM (SELECT draft_id, unnest(cluster_ids) AS raw, unnest(range(1, len(cluster_ids) + 1)) AS i FROM story_drafts) WHERE trim(raw) <> '' GROUP BY 1, 2) r
  JOIN candidate_stories c ON c.cluster_id = r.cid)"""

_SCORED = f"""
 SELECT profile_id, cluster_id, section, headline, priority_sections, confidence_rank,
  CAST(round({WEIGHTS["interest"]} * ih * traits.personal_interest_weight + {WEIGHTS["market"]} * mh * traits.market_focus + {WEIGHTS["macro"]} * macro * traits.macro_orientation
   + {WEIGHTS["urgency"]} * urgency * traits.urgency_sensitivity + {WEIGHTS["novelty"]} * novelty * traits.novelty_appetite + {WEIGHTS["contrarian"]} * contrarian * traits.contrarian_appetite
   + {WEIGHTS["confidence"]} * confidence_rank * traits.skepticism + {WEIGHTS["positive"]} * positive * traits.optimism - {WEIGHTS["sensational"]} * sensational * traits.calmness
   - {WEIGHTS["noise"]} * (low + long) * traits.signal_to_noise_strictness, 6) AS DOUBLE) AS score,
  array_to_string(list_filter([CASE WHEN ih > 0 THEN 'interest_hits=' || ih END, CASE WHEN mh > 0 THEN 'market_section_boost' END, CASE WHEN macro > 0 THEN 'macro_hits=' || macro END,
   CASE WHEN urgency > 0 THEN 'urgency_hits=' || urgency END, CASE WHEN novelty > 0 THEN 'novelty_hits=' || novelty END, CASE WHEN contrarian > 0 THEN 'contrarian_hits=' || contrarian END,
   CASE WHEN low > 0 THEN 'low_confidence_penalty' END, CASE WHEN long > 0 THEN 'long_item_penalty' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT p.*, i.cluster_id, i.section, i.headline, {CONFIDENCE.format("source_count").replace("'high'", "3").replace("'medium'", "2").replace("'low'", "1")} AS confidence_rank,
   len(list_filter(p.interests, lambda k: length(k) > 0 AND contains(t, lower(k)))) AS ih, CASE WHEN section = 'market' THEN 1 ELSE 0 END AS mh,
   {", ".join(f"{_hits(v, 't')} AS {k}" for k, v in SIGNALS.items())},
   CASE WHEN source_count < 2 THEN 1 ELSE 0 END AS low, CASE WHEN length(summary) > 300 THEN 1 ELSE 0 END AS long
  FROM (SELECT *, lower(concat_ws(' ', headline, summary)) AS t FROM (SELECT cluster_id, section, source_count, coalesce(representative_titles[1], '') AS headline, coalesce(candidate_text, '') AS summary FROM candidate_stories)) i, reader_profiles p)"""

SQL: dict[str, str] = {
    "article_titles": f"SELECT row_id, title_norm, CAST(len(words) AS INTEGER) AS n_words FROM {WORDS}",
    "article_sections": f"SELECT row_id, section FROM ({SECTIONS})",
    "section_sources": f"SELECT section, source, count(*) AS n_rows, count(DISTINCT article_id) AS n_articles FROM ({SECTIONS}) GROUP BY 1, 2",
    "first_wins": """SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY CASE WHEN nullif(trim(url), '') IS NOT NULL THEN 'u' || trim(url)
        WHEN nullif(trim(article_id), '') IS NOT NULL THEN 'a' || trim(article_id) ELSE 'r' || row_id END ORDER BY row_id) AS n FROM articles) WHERE n = 1""",
    "source_limit": "SELECT row_id, source FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) AS n FROM articles) WHERE n <= 20",
    "source_addresses": """SELECT name, source_access_tier, CASE WHEN access_type IN ('rss', 'rss_scrape') THEN nullif(trim(url), '') END AS rss_url, CASE WHEN access_type = 'api' THEN nullif(trim(url), '') END AS api_url,
        CASE WHEN access_type = 'scrape' THEN nullif(trim(url), '') END AS scrape_url, CAST((access_type = 'rss_scrape')::INTEGER + (access_type <> 'api' AND source_access_tier = 'api_fulltext')::INTEGER
          + (access_type = 'api' AND source_access_tier IN ('rss_only', 'rss_plus_extract'))::INTEGER + (coalesce(trim(category), '') = '')::INTEGER AS INTEGER) AS n_faults FROM sources""",
    "reader_profile": """SELECT profile_id, profile_name, CAST(len(interests) AS INTEGER) AS n_interests, array_to_string(priority_sections, ',') AS sections FROM reader_profiles WHERE is_default ORDER BY profile_id LIMIT 1""",
    "fair_share": """SELECT name, CAST(least(60 // n + CASE WHEN i <= 60 % n THEN 1 ELSE 0 END, 8) AS INTEGER) AS budget FROM (
        SELECT name, row_number() OVER (ORDER BY name) AS i, count(*) OVER () AS n FROM sources WHERE enabled AND access_type <> 'scrape' AND source_access_tier = 'rss_plus_extract')""",
    "extraction_attempts": """WITH b AS (SELECT name, least(60 // n + CASE WHEN i <= 60 % n THEN 1 ELSE 0 END, 8) AS budget FROM (
        SELECT name, row_number() OVER (ORDER BY name) AS i, count(*) OVER () AS n FROM sources WHERE enabled AND access_type <> 'scrape' AND source_access_tier = 'rss_plus_extract'))
        SELECT row_id, row_number() OVER (PARTITION BY source ORDER BY row_id) <= coalesce(budget, 0) AS attempt FROM articles LEFT JOIN b ON b.name = source""",
    "upsert": """SELECT CASE WHEN key[1] = 'u' THEN first_id ELSE article_id END AS article_id, url, row_id FROM (
        SELECT *, first_value(article_id) OVER (PARTITION BY key ORDER BY batch_no > 0, row_id) AS first_id, row_number() OVER (PARTITION BY key ORDER BY batch_no > 0 DESC, row_id DESC) AS n
        FROM (SELECT *, CASE WHEN nullif(trim(url), '') IS NOT NULL THEN 'u' || url ELSE 'a' || article_id END AS key FROM articles)) WHERE n = 1""",
    "clean_rows": f"""SELECT row_id FROM (SELECT row_id, trim(regexp_replace(title, '{W}', ' ', 'g')) AS t, lower(concat_ws(' ', title, summary, content)) AS hay, lower(url) AS u,
          regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM articles)
        WHERE t <> '' AND lower(t) NOT IN ('(untitled)', 'untitled')
          AND NOT coalesce(list_max(list_transform(regexp_extract_all(t, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER))) < 2024, false)
          AND NOT ({_hits(("coupon", "sponsored", "underscored"), "hay")} > 0) AND NOT coalesce({_hits(("/deals/", "utm_", "?iid="), "u")} > 0, false)
          AND NOT coalesce(len(list_filter(string_split(lower(path), '/'), lambda x: x <> '')) = 0, false)
          AND NOT coalesce(len(list_filter(string_split(q, '&'), lambda kv: kv <> '' AND (starts_with(lower(split_part(kv, '=', 1)), 'utm_') OR starts_with(lower(split_part(kv, '=', 1)), 'ad_') OR lower(split_part(kv, '=', 1)) IN {_in((*AD_KEYS, "iid"))}))) > 0, false)""",
    "publisher_counts": f"""SELECT publisher, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM (SELECT source, CASE WHEN h IS NULL OR h = '' THEN 'unknown' WHEN len(l) < 3 THEN h
          WHEN array_to_string(l[-2:], '.') IN {_in(SECOND_LEVEL)} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS publisher
          FROM (SELECT source, h, string_split(h, '.') AS l FROM (SELECT source, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS h FROM articles))) GROUP BY 1""",
    "url_flags": f"""SELECT row_id, len(s) = 0 OR (contains(s[-1], '.') AND regexp_extract(s[-1], '\\.([^.]*)$', 1) IN {_in(MEDIA)}) OR (len(s) <= 2 AND len(list_filter(s, lambda x: x NOT IN {_in(FRONT_SEGMENTS)})) = 0)
          OR (len(s) <= 2 AND s[-1] IN {_in(FRONT_LAST)}) AS front,
          len(list_filter(string_split(q, '&'), lambda kv: kv <> '' AND (starts_with(lower(split_part(kv, '=', 1)), 'utm_') OR starts_with(lower(split_part(kv, '=', 1)), 'ad_') OR lower(split_part(kv, '=', 1)) IN {_in((*AD_KEYS, "iid"))}
            OR (length(regexp_replace(kv, '^[^=]*=?', '')) > 40 AND contains(lower(kv), 'revshare'))))) > 0 AS ad
        FROM (SELECT row_id, list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS s, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM articles WHERE url IS NOT NULL)""",
    "document_sentences": f"""SELECT source, count(*) AS n_documents, CAST(sum(len(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))) AS BIGINT) AS n_sentences
        FROM (SELECT source, regexp_replace(text, '^{W}|{W}$', '', 'g') AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
    "story_grades": f"""SELECT cluster_id, CASE WHEN source_count >= 3 AND len(article_ids) >= 3 THEN 'strong' WHEN source_count >= 2 AND len(article_ids) >= 2 THEN 'moderate' ELSE 'weak' END AS quality,
        {CONFIDENCE.format("source_count")} AS confidence,
        array_to_string(list_filter([{", ".join(f"CASE WHEN {_hits(v, TOLD)} > 0 THEN '{k}' END" for k, v in sorted(TAGS.items()))}], lambda x: x IS NOT NULL), ',') AS tags FROM candidate_stories""",
    "story_ranks": f"""SELECT cluster_id, section, CAST(row_number() OVER (PARTITION BY section ORDER BY {RANK}) AS INTEGER) AS place,
        cluster_quality IN ('moderate', 'strong') AND (section = 'personal_interest' OR source_count >= 2) AS core FROM candidate_stories""",
    "draft_stories": f"SELECT draft_id, position, cluster_id, section FROM {RESOLVED}",
    "draft_items": f"""WITH r AS (SELECT * FROM {RESOLVED}), d AS (SELECT draft_id, unnest(publisher_domains) AS dom FROM r), dc AS (SELECT draft_id, dom, count(*) AS n FROM d GROUP BY 1, 2),
        p AS (SELECT draft_id, dom FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY n DESC, dom) AS i FROM dc) WHERE i = 1),
        s AS (SELECT draft_id, section FROM (SELECT draft_id, section, row_number() OVER (PARTITION BY draft_id ORDER BY sum(source_count) DESC, CASE section WHEN 'market' THEN 0 WHEN 'general' THEN 1 ELSE 2 END) AS i FROM r GROUP BY draft_id, section) WHERE i = 1),
        a AS (SELECT draft_id, min(CASE cluster_quality WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END) AS q, list_distinct(flatten(list(publisher_domains))) AS doms, list_distinct(flatten(list(source_names))) AS feeds,
          list_distinct(flatten(list(article_ids))) AS ids, list_distinct(flatten(list(source_links))) AS links FROM r GROUP BY 1)
        SELECT a.draft_id, coalesce(p.dom, 'unknown') AS primary_publisher, s.section, CASE q WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS cluster_quality, CAST(greatest(len(doms), 1) AS INTEGER) AS source_count,
          CAST(len(feeds) AS INTEGER) AS feed_count, {CONFIDENCE.format("greatest(len(doms), 1)")} AS confidence, CAST(len(ids) AS INTEGER) AS n_articles, CAST(len(links) AS INTEGER) AS n_links
        FROM a LEFT JOIN p USING (draft_id) JOIN s USING (draft_id)""",
    "draft_forms": f"""SELECT draft_id, coalesce(len(list_filter(cluster_ids, lambda x: trim(x) <> '')) > 0 AND h <> '' AND s <> '' AND w <> '' AND NOT {"{t}".format(t="regexp_matches(s, '(:|;|-|[.][.][.])$|\\b([Tt]he|[Aa]nd|[Oo]r|[Tt]o|[Oo]f|[Ii]n)[.]$')")}
          AND NOT regexp_matches(w, '(:|;|-|[.][.][.])$|\\b([Tt]he|[Aa]nd|[Oo]r|[Tt]o|[Oo]f|[Ii]n)[.]$') AND n BETWEEN 2 AND 4, false) AS well_formed, CAST(n AS INTEGER) AS n_sentences
        FROM (SELECT *, len(list_filter(string_split(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM (
          SELECT draft_id, cluster_ids, trim(regexp_replace(headline, '{W}', ' ', 'g')) AS h, trim(regexp_replace(coalesce(summary, ''), '{W}', ' ', 'g')) AS s, trim(regexp_replace(why_it_matters, '{W}', ' ', 'g')) AS w FROM story_drafts))""",
    "item_stories": f"""WITH i AS (SELECT draft_id, unnest(list_distinct(flatten(list(article_ids)))) AS a FROM {RESOLVED} GROUP BY draft_id), n AS (SELECT draft_id, count(*) AS n FROM i GROUP BY 1),
        c AS (SELECT cluster_id, unnest(list_distinct(article_ids)) AS a FROM candidate_stories), m AS (SELECT cluster_id, count(*) AS m FROM c GROUP BY 1),
        x AS (SELECT draft_id, cluster_id, shared, shared = n AND n = m AS exact FROM (SELECT draft_id, cluster_id, count(*) AS shared FROM i JOIN c USING (a) GROUP BY 1, 2) JOIN n USING (draft_id) JOIN m USING (cluster_id))
        SELECT draft_id, cluster_id, shared, exact FROM (SELECT draft_id, cluster_id, shared, exact, bool_or(exact) OVER (PARTITION BY draft_id) AS any_exact FROM x) WHERE exact OR NOT any_exact""",
    "profile_scores": f"SELECT profile_id, cluster_id, score, reasons FROM ({_SCORED})",
    "profile_order": f"""SELECT profile_id, CAST(place AS INTEGER) AS place, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY
        list_position(list_concat(priority_sections, list_filter(['market', 'general', 'personal_interest'], lambda s: NOT list_contains(priority_sections, s))), section), score DESC, confidence_rank DESC, lower(headline), cluster_id) AS place FROM ({_SCORED})) WHERE place <= 20""",
    "ingest_counts": """SELECT source, count(*) AS n_rows, CAST(count_if(extraction_status = 'ok') AS BIGINT) AS n_ok, CAST(count_if(extraction_status = 'partial') AS BIGINT) AS n_partial, CAST(count_if(extraction_status = 'blocked') AS BIGINT) AS n_blocked,
        CAST(count_if(extraction_status = 'failed') AS BIGINT) AS n_failed, CAST(count_if(extraction_status = 'skipped') AS BIGINT) AS n_skipped, CAST(count_if(coalesce(eligible_for_brief, true)) AS BIGINT) AS n_eligible, CAST(count_if(coalesce(front_page_eligible, false)) AS BIGINT) AS n_front FROM articles GROUP BY 1""",
    "ingest_totals": """SELECT count(DISTINCT source) AS n_sources, count(*) AS n_rows, CAST(count_if(extraction_status = 'ok') AS BIGINT) AS n_ok, CAST(count_if(extraction_status = 'partial') AS BIGINT) AS n_partial, CAST(count_if(extraction_status = 'blocked') AS BIGINT) AS n_blocked,
        CAST(count_if(extraction_status = 'failed') AS BIGINT) AS n_failed, CAST(count_if(extraction_status = 'skipped') AS BIGINT) AS n_skipped, CAST(count_if(coalesce(eligible_for_brief, true)) AS BIGINT) AS n_eligible, CAST(count_if(coalesce(front_page_eligible, false)) AS BIGINT) AS n_front FROM articles""",
    "brief_search": """SELECT section, count(*) AS n_stories FROM candidate_stories WHERE contains(lower(concat_ws(' ', array_to_string(representative_titles, ' '), candidate_text, array_to_string(primary_entities, ' '), array_to_string(story_tags, ' '))), 'data centre') GROUP BY 1""",
}
_NOISE = ("script", "style", "noscript", "svg", "iframe", "template", "form", "nav", "footer", "header")
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&#x27;", "\'\'"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def _paragraphs() -> str:
    bare = "regexp_replace(raw_html, '(?s)<!--.*?-->', ' ', 'g')"
    bare = f"regexp_replace({bare}, '(?is)" + "|".join(f"<{t}[^>]*>.*?</{t}>" for t in _NOISE) + "', ' ', 'g')"
    text = "x"
    for name, sign in _ENTITIES:
        text = f"replace({text}, '{name}', '{sign}')"
    text = f"lower(trim(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '{W}', ' ', 'g')))"
    return f"""SELECT row_id, CAST(len(p) AS INTEGER) AS n_paragraphs, CAST(coalesce(list_sum(list_transform(p, lambda y: length(y))), 0) AS INTEGER) AS n_chars FROM (
        SELECT row_id, list_distinct(list_filter(list_transform(regexp_extract_all({bare}, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {text}), lambda y: length(y) >= 40)) AS p FROM articles WHERE raw_html IS NOT NULL)"""


SQL["page_paragraphs"] = _paragraphs()
SQL["canonical_urls"] = """SELECT row_id, lower(s) || '://' || lower(h) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (
        SELECT row_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS s, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p,
          array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') AS q FROM articles WHERE url IS NOT NULL)"""
SQL["store_stream"] = SQL["upsert"]
