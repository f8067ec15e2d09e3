"""From articles to stories: sections, similar titles, greedy groups and what a group is made of."""

from __future__ import annotations

from collections import defaultdict

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswerk.config import TAGS, ClusterRules, Vocabulary
from presswerk.functions.text import body_words, collapse, contains_any, entities, keyword_hits, literals, matching_ratio, normal_title, title_words
from presswerk.functions.urls import cluster_id, publisher
from presswerk.operators.graph import components
from presswerk.operators.records import merged_text
from presswerk.session import stage


def section(rows: DataFrame, words: Vocabulary = Vocabulary(), text: Column | None = None) -> DataFrame:
    """The rows with ``section``: personal interest by category or mark, market by keywords, else general."""
    text = F.lower(text if text is not None else merged_text())
    hits = {k: keyword_hits(F.col("_text"), getattr(words, k)) for k in ("market", "high_signal", "macro", "other")}
    rows = rows.withColumn("_text", text).withColumns({f"_{k}": v for k, v in hits.items()})
    category = F.trim(F.coalesce("category", F.lit("")))
    where = F.lower(F.concat_ws(" ", F.trim("source"), collapse("title"), "url"))
    personal = category.isin("golf", *words.personal_categories) | F.exists(literals(words.personal_marks), lambda m: F.contains(where, m))
    if "editorial_tier" in rows.columns:
        personal = personal | (F.coalesce("editorial_tier", F.lit("")) == "personal_radar")
    high = F.col("_high_signal") >= words.least_high
    signal = (F.col("_market") >= words.least_market) & high & (F.col("_market") >= F.col("_other") + words.margin)
    macro = (F.col("_macro") >= words.least_macro) & high & (F.col("_other") == 0)
    plain = contains_any(collapse("title"), words.excluded_titles)
    own = category.isin(*words.market_categories)
    passes = F.when(own & (category == "business_markets"), signal).when(own, macro).otherwise(~category.isin(*words.blocked_categories) & (signal | macro))
    named = F.when(personal, "personal_interest").when(passes & ~plain, "market").otherwise("general")
    return rows.withColumn("section", named).drop("_text", "_market", "_high_signal", "_macro", "_other")


def features(rows: DataFrame) -> DataFrame:
    """``_title``, ``_words``, ``_body`` and ``_names``: what the comparison of two articles reads."""
    full = F.concat_ws(" ", "title", F.coalesce("final_content_for_ai", "content_for_ai"))
    return rows.withColumns({"_title": normal_title("title"), "_words": title_words("title"), "_body": body_words(merged_text()), "_names": entities(full)})


def title_pairs(rows: DataFrame, key: str = "row_id", at: str = "published", hours: int = 72, least_jaccard: float = 0.34, least_shared: int = 2) -> DataFrame:
    """``(a, b, shared, jaccard)``: articles of one section whose title words overlap within a time window.

    A range join by buckets of the window's width: each article asks its own bucket and its neighbours. A title of n
    words can only reach the overlap if it shares one of its ``n - least overlap + 1`` rarest words, so titles meet by
    those alone (the order of words is their count over all titles, then the word) and the common words that would pair
    everything with everything are only counted when a pair is verified. No pair is lost.
    """
    width = hours * 3600
    base = rows.select(F.col(key).alias("id"), "section", F.unix_timestamp(at).alias("t"), title_words("title").alias("words")).where("t IS NOT NULL AND size(words) > 0")
    base = stage(base, "titles")
    long = base.select("id", F.explode("words").alias("word"))
    counted = long.join(long.groupBy("word").agg(F.count("*").alias("n")), "word")
    by_rarity = counted.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("rare"))
    size = F.size("rare")
    needed = F.greatest(F.ceil(F.lit(least_jaccard) * size - 1e-9).cast("int"), F.lit(least_shared))
    prefix = by_rarity.where(size >= least_shared).select("id", F.explode(F.slice("rare", F.lit(1), F.greatest(size - needed + 1, F.lit(1)))).alias("word"))
    met = prefix.join(base.select("id", "section", "t"), "id").withColumn("bucket", F.floor(F.col("t") / width))
    left = met.select(F.col("id").alias("a"), "section", "word", F.col("t").alias("ta"), "bucket")
    around = F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")
    right = met.select(F.col("id").alias("b"), "section", "word", F.col("t").alias("tb"), around)
    pairs = left.join(right, ["section", "word", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= width)).select("a", "b").distinct()
    words = lambda name, as_: base.select(F.col("id").alias(name), F.col("words").alias(as_))
    both = pairs.join(words("a", "wa"), "a").join(words("b", "wb"), "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")).cast("bigint"))
    share = F.col("shared") / (F.size("wa") + F.size("wb") - F.col("shared"))
    return both.where((F.col("shared") >= least_shared) & (share >= least_jaccard)).select("a", "b", "shared", share.alias("jaccard"))


def similar_titles(rows: DataFrame, key: str = "row_id", at: str = "published", hours: int = 72, least: float = 0.72) -> DataFrame:
    """``(a, b, ratio)``: pairs that share a fifth of their title words and match in ``least`` of their characters."""
    return _matching(title_pairs(rows, key, at, hours, 0.2, 1).select("a", "b"), rows, key, least)


def _matching(pairs: DataFrame, rows: DataFrame, key: str, least: float) -> DataFrame:
    named = rows.select(F.col(key).alias("id"), normal_title("title").alias("title"))
    both = pairs.join(named.select(F.col("id").alias("a"), F.col("title").alias("ta")), "a").join(named.select(F.col("id").alias("b"), F.col("title").alias("tb")), "b")
    # the shorter title bounds the ratio, so unequal lengths need no comparison
    able = both.where(2 * F.least(F.length("ta"), F.length("tb")) >= least * (F.length("ta") + F.length("tb")))
    return able.withColumn("ratio", matching_ratio("ta", "tb")).where(F.col("ratio") >= least).select("a", "b", "ratio")


def story_links(rows: DataFrame, key: str = "row_id", at: str = "published", hours: int = 72, least: float = 0.72) -> DataFrame:
    """``(a, b)``: every two articles of which one can be the first of a story and the other join it.

    They match in ``least`` of the characters of their titles, and share a title word or one of them shares it with a
    third that is so linked to the other: a story's words grow, its first title stays. Rounds end when none is new.
    """
    turned = lambda d: d.select("a", "b").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sharing = stage(title_pairs(rows, key, at, hours, 0.0, 1).select("a", "b"), "sharing")
    links, tried = stage(_matching(sharing, rows, key, least).select("a", "b"), "links"), sharing
    while True:
        on = turned(links).select(F.col("a").alias("b"), F.col("b").alias("c"))
        further = turned(sharing).join(on, "b").where("a != c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        further = stage(further.join(tried, ["a", "b"], "left_anti"), "further")
        found = stage(_matching(further, rows, key, least).select("a", "b"), "links")
        if found.isEmpty():
            return links
        links, tried = links.unionByName(found), tried.unionByName(further)


class _Group:
    """One story while it grows: its first title stays, its words and names are joined."""

    __slots__ = ("number", "title", "words", "body", "names", "latest")

    def __init__(self, number: int, row) -> None:
        self.number, self.title, self.latest = number, row.title, row.t
        self.words, self.body, self.names = set(row.words), set(row.body), set(row.names)

    def score(self, row, rules: ClusterRules) -> float:
        """How well a row fits; 0 if it doesn't."""
        if abs(row.t - self.latest) > rules.window_hours * 3600 or not row.title or not self.title:
            return 0.0
        shared = len(self.words.intersection(row.words))
        if not shared:
            return 0.0
        body_all = len(self.body.union(row.body)) if self.body and len(row.body) else 0
        body = len(self.body.intersection(row.body)) / body_all if body_all else 0.0
        names = len(self.names.intersection(row.names))
        near_body, near_names = body >= rules.body_jaccard, names >= rules.shared_entities
        if not (near_body or near_names):
            return 0.0
        ratio = SequenceMatcher(None, row.title, self.title).ratio()
        strict = shared >= rules.shared_title_words and ratio >= rules.title_ratio and shared / len(self.words.union(row.words)) >= rules.title_jaccard
        loose = near_body and near_names and ratio >= rules.loose_ratio
        return ratio + body + 0.2 * min(names, 3) if strict or loose else 0.0

    def take(self, row) -> None:
        self.latest = max(self.latest, row.t)
        self.words.update(row.words)
        self.body.update(row.body)
        self.names.update(row.names)


def grow_groups(rows, rules: ClusterRules = ClusterRules()) -> list[int]:
    """The group number of each row, taken in the given order; each joins the group it fits best (the first of equals)
    or opens a new one. Only groups that share a title word are looked at: no other can fit."""
    groups: list[_Group] = []
    by_word: dict[str, set[int]] = defaultdict(set)
    out = []
    for row in rows:
        best, most = None, 0.0
        for number in sorted(set().union(*(by_word[w] for w in row.words if w in by_word))):
            fit = groups[number].score(row, rules)
            if fit > most:
                best, most = number, fit
        if best is None:
            best = len(groups)
            groups.append(_Group(best, row))
        else:
            groups[best].take(row)
        for w in row.words:
            by_word[w].add(best)
        out.append(best)
    return out


def clusters(rows: DataFrame, rules: ClusterRules = ClusterRules(), key: str = "row_id", at: str = "published") -> DataFrame:
    """``(key, section, cluster, anchor)``: the story of each article, named by the key of its first article.

    Articles are first parted into blocks that can't meet: connected components of ``story_links`` within a section and
    the time window. Blocks are as small as stories are, so the order-dependent growth runs in as many tasks as there are
    blocks, and no section lands in one task. Rows without a time or title have no story; ties go by key.
    """
    rows = features(rows.where(F.col(at).isNotNull() & (normal_title("title") != "")))
    links = story_links(rows, key, at, rules.window_hours, rules.loose_ratio)
    blocks = components(links)
    seen = rows.select(F.col(key).alias("id"), "section", F.unix_timestamp(at).alias("t"), F.col("_title").alias("title"), F.col("_words").alias("words"), F.col("_body").alias("body"), F.col("_names").alias("names"))
    parted = seen.join(blocks, "id", "left").withColumn("block", F.coalesce("root", "id"))
    alone = parted.where("root IS NULL").select(F.col("id").alias(key), "section", F.col("id").alias("cluster"), F.col("title").alias("anchor"))

    def grow(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["t", "id"], ascending=[False, True])
        out = []
        for name, part in block.groupby("section", sort=True):
            numbers = grow_groups(list(part.itertuples(index=False)), rules)
            first = {}
            for n, row in zip(numbers, part.itertuples(index=False), strict=True):
                ident, title = first.setdefault(n, (row.id, row.title))
                out.append((row.id, name, ident, title))
        return pd.DataFrame(out, columns=[key, "section", "cluster", "anchor"])

    together = parted.where("root IS NOT NULL").drop("root").groupBy("block").applyInPandas(grow, f"{key} bigint, section string, cluster bigint, anchor string")
    return together.unionByName(alone)


def quality(articles: Column, sources: Column) -> Column:
    return F.when((sources >= 3) & (articles >= 3), "strong").when((sources >= 2) & (articles >= 2), "moderate").otherwise("weak")


def confidence(sources: Column) -> Column:
    return F.when(sources >= 3, "high").when(sources == 2, "medium").otherwise("low")


def tags(titles: Column, text: Column) -> Column:
    """The tags of which any word occurs, in order of name."""
    hay = F.lower(F.concat_ws(" ", F.array_join(titles, " "), text))
    return F.array_compact(F.array(*[F.when(F.exists(literals(words), lambda w: F.contains(hay, w)), F.lit(tag)) for tag, words in sorted(TAGS.items())]))


def top_names(members: DataFrame, most: int = 5) -> DataFrame:
    """``(cluster, names)``: the names most articles of a story have, by count, then name; one count an article."""
    long = members.select("cluster", F.explode(entities(F.concat_ws(" ", "title", F.coalesce("final_content_for_ai", "content_for_ai")))).alias("name"))
    counted = long.groupBy("cluster", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), F.lower("name"), "name"))
    kept = counted.withColumn("place", rank).where(F.col("place") <= most)
    return kept.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def story_text(members: DataFrame, most: int = 4000, key: str = "row_id", at: str = "published") -> DataFrame:
    """``(cluster, text)``: the different texts of a story, newest first, until ``most`` characters are reached."""
    block = F.coalesce(*[collapse(c) for c in ("final_content_for_ai", "content_for_ai", "summary", "content", "title")])
    order = [F.desc(at), F.col("source"), F.col("title"), F.col(key)]
    texts = members.select("cluster", key, at, "source", "title", block.alias("block"), normal_title(block).alias("same")).where("same != ''")
    first = texts.withColumn("nth", F.row_number().over(Window.partitionBy("cluster", "same").orderBy(*order))).where("nth = 1")
    running = Window.partitionBy("cluster").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = first.withColumn("before", F.coalesce(F.sum(F.length("block")).over(running), F.lit(0))).where(F.col("before") < most)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(*order))
    joined = kept.withColumn("place", place).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]).alias("blocks"))
    return joined.select("cluster", F.rtrim(F.substring(F.array_join("blocks", " "), 1, most)).alias("text"))


def candidates(members: DataFrame, rules: ClusterRules = ClusterRules(), key: str = "row_id", at: str = "published", least_text: int = 160) -> DataFrame:
    """One row a story with its ids, links, publishers, titles, text, names and tags; newest article first.

    A story without a usable headline, an id or ``least_text`` characters is left out. Publishers are counted over the
    links a story keeps, feeds over all its articles.
    """
    members = stage(members, "members")
    sort = F.sort_array(F.collect_list(F.struct((-F.unix_timestamp(at)).alias("t"), "source", "title", F.col(key).alias("k"), "article_id", "url", "section", "anchor")))
    row = members.groupBy("cluster").agg(sort.alias("a"))
    each = lambda f: F.transform("a", lambda x: x[f])
    filled = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))
    row = row.select(
        "cluster",
        filled(each("article_id")).alias("article_ids"),
        filled(each("url")).alias("urls"),
        F.array_distinct(F.transform(each("source"), lambda s: F.coalesce(s, F.lit("unknown")))).alias("source_names"),
        F.slice(filled(F.transform(each("title"), lambda t: collapse(t))), 1, 3).alias("representative_titles"),
        F.get("a", F.lit(0))["section"].alias("section"),
        F.get("a", F.lit(0))["anchor"].alias("anchor"),
        F.size("a").alias("n_articles"),
    )
    links = F.when(F.size("urls") > 0, F.col("urls")).otherwise(F.transform("article_ids", lambda i: F.concat(F.lit("article:"), i)))
    row = row.withColumn("source_links", F.slice(links, 1, rules.most_links)).withColumn("publisher_domains", F.array_distinct(F.transform("source_links", lambda x: publisher(x))))
    row = row.join(story_text(members, rules.most_text_chars, key, at).withColumnRenamed("text", "candidate_text"), "cluster").join(top_names(members).withColumnRenamed("names", "primary_entities"), "cluster", "left")
    headline = F.get("representative_titles", F.lit(0))
    row = row.where(headline.isNotNull() & ~F.lower(headline).isin("(untitled)", "untitled") & (F.size("article_ids") > 0) & (F.length("candidate_text") >= least_text))
    sources = F.size("publisher_domains")
    return row.select(
        cluster_id("article_ids", "section", "anchor").alias("cluster_id"),
        "article_ids",
        "source_links",
        sources.alias("source_count"),
        F.size("source_names").alias("feed_count"),
        "source_names",
        "publisher_domains",
        F.get("publisher_domains", F.lit(0)).alias("primary_publisher"),
        "section",
        "representative_titles",
        "candidate_text",
        F.coalesce("primary_entities", F.array().cast("array<string>")).alias("primary_entities"),
        tags(F.col("representative_titles"), F.col("candidate_text")).alias("story_tags"),
        quality(F.col("n_articles"), sources).alias("cluster_quality"),
    )


