"""From stories to a brief: choice under quotas, drafts against evidence, reader score, order and output."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from presswerk.config import SECTIONS, SIGNALS, THEMES, TRAITS, WEIGHTS, SelectionRules
from presswerk.functions.text import collapse, ensure_sentence, keyword_hits, literals, looks_truncated, mentions, sentence_count, sentences, word_set
from presswerk.functions.urls import source_links
from presswerk.operators.stories import confidence


def rank_of(values: tuple[str, ...], c: str | Column) -> Column:
    """The place of a value in ``values``, from 0; others come last."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(c == v, i).otherwise(out)
    return out


def selection_order() -> list[Column]:
    """Better quality, more sources, more articles, section, id."""
    return [rank_of(("strong", "moderate"), "cluster_quality"), F.desc("source_count"), F.desc(F.size("article_ids")), rank_of(SECTIONS, "section"), F.col("cluster_id")]


def is_core(rules: SelectionRules) -> Column:
    good = F.col("cluster_quality").isin(*rules.core_qualities)
    return good & ((F.col("section") == "personal_interest") | (F.col("source_count") >= rules.core_least_sources))


def shortlist(stories: DataFrame, rules: SelectionRules = SelectionRules()) -> DataFrame:
    """The stories that a choice could take: per section and eligibility the best ``most_items`` of each publisher, of
    the best ``most_items`` publishers. At most 6 x most_items x most_items rows, whatever the number of stories."""
    core = F.coalesce(is_core(rules), F.lit(False))
    name = F.coalesce("primary_publisher", F.lit("unknown"))
    rows = stories.withColumn("core", core).withColumn("_p", name)
    group = ["section", "core", "_p"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*selection_order()))
    rows = rows.withColumn("_n", place).where(F.col("_n") <= rules.most_items)
    best = rows.where("_n = 1").withColumn("_b", F.row_number().over(Window.partitionBy("section", "core").orderBy(*selection_order())))
    kept = best.where(F.col("_b") <= rules.most_items).select(*group)
    return rows.join(kept, group).drop("_p", "_n")


def choose(ranked: list[Row], rules: SelectionRules = SelectionRules()) -> list[tuple[str, str]]:
    """``(cluster_id, mode)`` in order of choice, from ranked stories with ``core``.

    First each section's minimum, then the rest by rank, each publisher up to its cap; then what the cap held back; and
    if the brief is still too short, weak stories first and any other after, as ``backfill``.
    """
    taken: dict[str, str] = {}
    per_publisher: Counter = Counter()
    per_section: Counter = Counter()
    core = [r for r in ranked if r["core"]]
    weak = [r for r in ranked if not r["core"] and (r["cluster_quality"] == "weak" or (r["section"] == "personal_interest" and rules.allow_weak))]
    held: list[Row] = []

    def take(rows: Iterable[Row], full, capped: bool, mode: str = "primary") -> None:
        for r in rows:
            if full() or len(taken) >= rules.most_items:
                return
            name = r["primary_publisher"] or "unknown"
            if r["cluster_id"] in taken:
                continue
            if capped and per_publisher[name] >= rules.publisher_cap:
                held.append(r)
                continue
            taken[r["cluster_id"]] = mode
            per_publisher[name] += 1
            per_section[r["section"]] += 1

    for name, least in rules.minimums().items():
        own = [r for r in core if r["section"] == name]
        for capped in (True, False):
            take(own, lambda name=name, least=least: per_section[name] >= least, capped)
    take(core, lambda: False, True)
    take(list(held), lambda: False, False)
    rest = [r for r in ranked if r["cluster_id"] not in taken and not any(r is w for w in weak)]
    take([*weak, *rest], lambda: len(taken) >= rules.least_items, False, "backfill")
    return list(taken.items())


def selected(stories: DataFrame, rules: SelectionRules = SelectionRules()) -> DataFrame:
    """``(position, cluster_id, mode)`` of the chosen stories. The choice depends on itself, so it runs over the
    shortlist, which is bounded by the rules and not by the data."""
    short = shortlist(stories, rules).orderBy(*selection_order())
    rows = short.select("cluster_id", "section", "primary_publisher", "cluster_quality", "source_count", "core").collect()
    chosen = [(i, c, m) for i, (c, m) in enumerate(choose(rows, rules), 1)]
    return stories.sparkSession.createDataFrame(chosen, "position int, cluster_id string, mode string")


def resolved_drafts(drafts: DataFrame, stories: DataFrame) -> DataFrame:
    """``(draft_id, position, cluster_id, ...)``: the known stories a draft names, blank and unknown ids dropped."""
    ids = drafts.select("draft_id", F.posexplode("cluster_ids").alias("position", "raw"))
    ids = ids.withColumn("cluster_id", F.trim("raw")).where("cluster_id != ''").groupBy("draft_id", "cluster_id").agg(F.min("position").alias("position"))
    return ids.join(stories, "cluster_id")


def joined_items(resolved: DataFrame) -> DataFrame:
    """One item a draft from its stories, in the order it names them: united lists, publishers, section and quality."""
    lists = ("source_links", "article_ids", "publisher_domains", "source_names", "primary_entities", "story_tags")
    cols = [F.struct("position", "cluster_id", "section", "source_count", "cluster_quality", *lists).alias("s")]
    rows = resolved.select("draft_id", *cols).groupBy("draft_id").agg(F.sort_array(F.collect_list("s")).alias("s"))

    def union(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("s", lambda x: x[name])))

    domains = F.flatten(F.transform("s", lambda x: x["publisher_domains"]))
    counted = F.transform(F.array_distinct(domains), lambda d: F.struct((-F.size(F.filter(domains, lambda x: x == d))).alias("n"), d.alias("d")))
    weight = lambda name: F.aggregate(F.filter("s", lambda x: x["section"] == name), F.lit(0), lambda t, x: t + x["source_count"])
    sections = F.array(*[F.struct((-weight(n)).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(SECTIONS)])
    grade = F.array_min(F.transform("s", lambda x: rank_of(("strong", "moderate"), x["cluster_quality"])))
    sources = F.greatest(F.size(union("publisher_domains")), F.lit(1))
    return rows.select(
        "draft_id",
        F.transform("s", lambda x: x["cluster_id"]).alias("cluster_ids"),
        union("source_links").alias("source_links"),
        union("article_ids").alias("article_ids"),
        union("publisher_domains").alias("publisher_domains"),
        F.coalesce(F.array_min(counted)["d"], F.lit("unknown")).alias("primary_publisher"),
        F.array_min(sections)["n"].alias("section"),
        F.when(grade == 0, "strong").when(grade == 1, "moderate").otherwise("weak").alias("cluster_quality"),
        sources.alias("source_count"),
        F.size(union("source_names")).alias("feed_count"),
        confidence(sources).alias("confidence"),
        F.slice(union("primary_entities"), 1, 5).alias("primary_entities"),
        F.slice(union("story_tags"), 1, 8).alias("story_tags"),
    )


def stories_of_items(items: DataFrame, tales: DataFrame, key: str = "item_id") -> DataFrame:
    """``(key, cluster_id, shared, exact)``: the stories an item's articles belong to.

    A story with exactly the item's set of article ids is its story; only where there is none, all stories that share an
    id are. One equi-join over the ids; the sizes tell equality.
    """
    mine = items.select(key, F.explode(F.array_distinct("article_ids")).alias("article"), F.size(F.array_distinct("article_ids")).alias("n"))
    theirs = tales.select("cluster_id", F.explode(F.array_distinct("article_ids")).alias("article"), F.size(F.array_distinct("article_ids")).alias("m"))
    met = mine.join(theirs, "article").groupBy(key, "cluster_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    met = met.withColumn("exact", (F.col("shared") == F.col("n")) & (F.col("n") == F.col("m")))
    best = met.groupBy(key).agg(F.bool_or("exact").alias("any"))
    return met.join(best, key).where(F.col("exact") | ~F.col("any")).select(key, "cluster_id", "shared", "exact")


def is_well_formed(ids: str = "cluster_ids", headline: str = "headline", summary: str = "summary", why: str = "why_it_matters") -> Column:
    """Ids, a headline, a whole summary of two to four sentences and a whole reason."""
    named = F.size(F.filter(ids, lambda x: F.trim(x) != "")) > 0
    s, w = collapse(summary), collapse(why)
    n = sentence_count(s)
    return F.coalesce(named & collapse(headline).isNotNull() & s.isNotNull() & w.isNotNull() & ~looks_truncated(s) & ~looks_truncated(w) & (n >= 2) & (n <= 4) & (sentence_count(w) >= 1), F.lit(False))


def grounded(drafts: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(draft_id, overlap, unsupported, grounded)`` of every draft with stories: words it shares with their titles
    and texts, and the names it has that they don't. A draft whose stories have no words is grounded."""
    told = F.concat_ws(" ", F.array_join("representative_titles", " "), "candidate_text")
    each = F.collect_list(F.struct("position", told.alias("told"), "primary_entities"))
    evidence = resolved.groupBy("draft_id").agg(F.sort_array(each).alias("e"))
    evidence = evidence.select(
        "draft_id",
        F.array_join(F.transform("e", lambda x: x["told"]), " \n ").alias("told"),
        F.transform(F.flatten(F.transform("e", lambda x: x["primary_entities"])), lambda n: F.lower(collapse(n, empty=True))).alias("named"),
    )
    rows = drafts.select("draft_id", *[collapse(c, empty=True).alias(c) for c in ("headline", "summary", "why_it_matters")]).join(evidence, "draft_id")
    known, own = word_set("told"), word_set(F.concat_ws(" ", "headline", "summary", "why_it_matters"))
    shared = lambda c: F.size(F.array_intersect(known, c))
    supported = F.array_union(mentions("told"), F.col("named"))
    foreign = F.when(F.size(supported) > 0, F.array_except(mentions(F.concat_ws(" ", "headline", "summary")), supported)).otherwise(F.array().cast("array<string>"))
    needed = F.when(F.size(known) >= 30, 3).otherwise(2)
    fits = (F.size(own) > 0) & (shared(own) >= needed) & (shared(word_set("headline")) >= 1) & (shared(word_set("summary")) >= 2) & (F.size(foreign) == 0)
    return rows.select("draft_id", shared(own).alias("overlap"), F.size(foreign).alias("unsupported"), ((F.size(known) == 0) | fits).alias("grounded"))


def accept_drafts(drafts: DataFrame, stories: DataFrame, most: int = 20) -> DataFrame:
    """``(position, draft_id, cluster_ids)``: well-formed drafts in order, each with the stories no earlier one used.

    The used-once rule depends on earlier drafts; as a brief takes at most ``most`` drafts, the drafts are read in
    order and only until enough are accepted. Grounding is judged over all stories a draft names.
    """
    resolved = resolved_drafts(drafts, stories)
    fine = grounded(drafts, resolved).where("grounded").select("draft_id")
    good = drafts.where(is_well_formed()).select("draft_id").join(fine, "draft_id")
    ids = resolved.select("draft_id", "position", "cluster_id").join(good, "draft_id")
    rows = ids.groupBy("draft_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "cluster_id"))), lambda x: x["cluster_id"]).alias("ids")).orderBy("draft_id")
    used: set[str] = set()
    out = []
    for r in rows.toLocalIterator():
        free = [c for c in r["ids"] if c not in used]
        if free:
            used.update(free)
            out.append((len(out) + 1, r["draft_id"], free))
        if len(out) >= most:
            break
    return drafts.sparkSession.createDataFrame(out, "position int, draft_id bigint, cluster_ids array<string>")


def _constant(profile: Row) -> Column:
    names = lambda values: literals(list(values or ()))
    traits = F.struct(*[F.lit(profile["traits"][t] if profile["traits"] else None).cast("int").alias(t) for t in TRAITS])
    return F.struct(F.lit(profile["profile_id"]).alias("profile_id"), names(profile["interests"]).alias("interests"), traits.alias("traits"), names(profile["priority_sections"]).alias("priority_sections"))


def scored(items: DataFrame, profiles: DataFrame, text: Column, length: Column) -> DataFrame:
    """Each item for each profile with ``score``, ``reasons`` and the hits behind them.

    The profiles are a stated set of readers: they are read to the driver (at most ``MOST_PROFILES``) and put into the
    plan as one constant array, so items are scored where they lie. Needs ``section`` and ``confidence``.
    """
    held = profiles.select("profile_id", "interests", "traits", "priority_sections").orderBy("profile_id").limit(MOST_PROFILES + 1).collect()
    if len(held) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles: score them in blocks")
    rows = items.withColumn("_text", F.lower(text)).withColumn("_length", length)
    rows = rows.withColumns({f"{k}_hits": keyword_hits("_text", v) for k, v in SIGNALS.items()})
    readers = F.array(*[_constant(r) for r in held])
    rows = rows.select("*", F.inline(readers))
    wanted = F.filter(F.transform("interests", lambda i: F.lower(i)), lambda i: F.length(i) > 0)
    rows = rows.withColumn("interest_hits", F.size(F.filter(wanted, lambda i: F.contains(F.col("_text"), i))))
    rows = rows.withColumn("market_hit", (F.col("section") == "market").cast("int")).withColumn("low", (F.col("confidence") == "low").cast("int")).withColumn("long", (F.col("_length") > 300).cast("int"))
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    t = {n: F.col(f"traits.{n}") for n in TRAITS}
    score = (
        F.lit(WEIGHTS["interest"]) * F.col("interest_hits") * t["personal_interest_weight"]
        + F.lit(WEIGHTS["market"]) * F.col("market_hit") * t["market_focus"]
        + F.lit(WEIGHTS["macro"]) * F.col("macro_hits") * t["macro_orientation"]
        + F.lit(WEIGHTS["urgency"]) * F.col("urgency_hits") * t["urgency_sensitivity"]
        + F.lit(WEIGHTS["novelty"]) * F.col("novelty_hits") * t["novelty_appetite"]
        + F.lit(WEIGHTS["contrarian"]) * F.col("contrarian_hits") * t["contrarian_appetite"]
        + F.lit(WEIGHTS["confidence"]) * sure * t["skepticism"]
        + F.lit(WEIGHTS["positive"]) * F.col("positive_hits") * t["optimism"]
        - F.lit(WEIGHTS["sensational"]) * F.col("sensational_hits") * t["calmness"]
        - F.lit(WEIGHTS["noise"]) * (F.col("low") + F.col("long")) * t["signal_to_noise_strictness"]
    )
    note = lambda c, label: F.when(F.col(c) > 0, F.concat(F.lit(label), F.lit("="), F.col(c).cast("string")))
    reasons = F.array_compact(
        F.array(
            note("interest_hits", "interest_hits"),
            F.when(F.col("market_hit") > 0, F.lit("market_section_boost")),
            *[note(f"{n}_hits", f"{n}_hits") for n in ("macro", "urgency", "novelty", "contrarian")],
            F.when(F.col("low") > 0, F.lit("low_confidence_penalty")),
            F.when(F.col("long") > 0, F.lit("long_item_penalty")),
        )
    )
    return rows.withColumn("score", score).withColumn("reasons", reasons).withColumn("confidence_rank", sure).drop("_text", "_length", "market_hit", "low", "long")


def section_rank(priority: str = "priority_sections") -> Column:
    """A profile's own order of sections, those it doesn't name after them in the usual order."""
    order = F.array_distinct(F.concat(F.coalesce(priority, F.array().cast("array<string>")), literals(SECTIONS)))
    return F.array_position(order, F.col("section"))


def ordered_items(items: DataFrame, key: str = "cluster_id", headline: str = "headline") -> DataFrame:
    """Scored items with ``place`` within their profile: section, score, confidence, headline, key."""
    order = [section_rank(), F.desc("score"), F.desc("confidence_rank"), F.lower(headline), F.col(key)]
    return items.withColumn("place", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order)))


def compressed(text: str | Column, strictness: Column) -> Column:
    """Two sentences for the strict, three for the middling, all for the rest."""
    parts = sentences(text)
    return F.array_join(F.when(strictness >= 4, F.slice(parts, 1, 2)).when(strictness == 3, F.slice(parts, 1, 3)).otherwise(parts), " ")


def noted(text: Column, confidence_of: Column, hits: dict[str, Column], traits: dict[str, Column], notes: dict[str, str]) -> Column:
    """A compressed text in a reader's manner: calm readers get no exclamation, and up to one, two or three notes follow.

    ``notes`` gives the wording for ``high``, ``medium``, ``low`` and for each kind of hit; a note stands if its trait
    is at least 4 and its hit or confidence is there.
    """
    calm = F.when(traits["calmness"] >= 4, F.replace(text, F.lit("!"), F.lit("."))).otherwise(text)
    sure = F.when(traits["skepticism"] >= 4, F.coalesce(*[F.when(confidence_of == k, F.lit(notes[k])) for k in ("high", "medium") if k in notes], F.lit(notes.get("low"))))
    by_trait = {"urgency": "urgency_sensitivity", "novelty": "novelty_appetite", "macro": "macro_orientation", "contrarian": "contrarian_appetite"}
    more = [F.when((traits[t] >= 4) & (hits[k] > 0), F.lit(notes[k])) for k, t in by_trait.items() if k in notes and k in hits]
    strict = traits["signal_to_noise_strictness"]
    most = F.when(strict >= 4, 1).when(strict == 3, 2).otherwise(3)
    return F.array_join(F.concat(F.array(ensure_sentence(calm, fold=False)), F.slice(F.array_compact(F.array(sure, *more)), 1, most)), " ")


def intro_fits(intro: str, focus: str | None, theme: str | None, most_words: int = 35) -> bool:
    """One sentence of at most ``most_words`` words that names the reader's focus and the theme where there are any."""
    text = " ".join((intro or "").split())
    one = len([s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]) == 1
    low = text.lower()
    return bool(text) and one and len(text.split()) <= most_words and (not focus or focus.lower() in low) and (not theme or theme.lower() in low)


def interest_focus(items: DataFrame, text: Column, interests: list[str]) -> str | None:
    """The first interest found in any item, else the first of their words of three letters and more."""
    tries = [i.lower() for i in interests if i.strip()]
    tries += [w for i in tries for w in i.split() if len(w) >= 3]
    if not tries:
        return None
    found = items.agg(*[F.max(F.contains(F.lower(text), F.lit(w)).cast("int")).alias(f"c{k}") for k, w in enumerate(tries)]).first()
    return next((w for w, hit in zip(tries, found, strict=True) if hit), None)


def macro_theme(items: DataFrame, text: Column) -> str | None:
    """The label of the first theme word that occurs in market and general items."""
    rows = items.where(F.col("section").isin("market", "general"))
    found = rows.agg(*[F.max(F.contains(F.lower(text), F.lit(w)).cast("int")).alias(f"c{k}") for k, w in enumerate(THEMES)]).first()
    return next((THEMES[w] for w, hit in zip(THEMES, found, strict=True) if hit), None)


def counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("final_items"), *[F.count_if(F.col("section") == s).alias(s) for s in SECTIONS])


def payload(items: DataFrame, order: tuple[str, ...] = SECTIONS) -> DataFrame:
    """``(name, items)`` per section in the given order; a section without items has an empty list."""
    item = F.struct("place", "headline", "summary", "why_it_matters", "confidence", "source_count", "feed_count", "source_links", "cluster_quality")
    spark = items.sparkSession
    names = spark.createDataFrame(list(enumerate(order)), "at int, name string")
    grouped = items.groupBy(F.col("section").alias("name")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return names.join(grouped, "name", "left").select("at", "name", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)).alias("items")).orderBy("at")


MOST_PROFILES = 1000
LABELS = {"market": "Market", "general": "General", "personal_interest": "Personal Interest"}


def item_markdown() -> Column:
    """One item of a brief as Markdown lines."""
    head = F.concat(F.lit("- **"), F.col("headline"), F.lit("** (`"), F.col("confidence"), F.lit("` | sources="), F.col("source_count").cast("string"), F.lit(" | quality="), F.col("cluster_quality"), F.lit(")"))
    return F.concat_ws("\n", head, F.concat(F.lit("  "), F.col("summary")), F.concat(F.lit("  Why it matters: "), F.col("why_it_matters")), F.concat(F.lit("  Sources: "), source_links("source_links")))


def brief_markdown(items: DataFrame, intro: str = "", window: tuple[str, str] = ("", ""), order: tuple[str, ...] = SECTIONS) -> str:
    """The brief of at most a few dozen placed items as one Markdown text."""
    rows = items.select("section", "place", item_markdown().alias("md")).orderBy("place").collect()
    lines = ["# Daily Brief", "", f"Window: {window[0]} -> {window[1]}", *(["", intro] if intro else []), ""]
    for name in order:
        own = [r["md"] for r in rows if r["section"] == name]
        lines += [f"## {LABELS.get(name, name)}", *(own or ["- No items."]), ""]
    return "\n".join(lines).rstrip() + "\n"


