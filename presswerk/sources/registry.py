"""The register of sources and the readers' profiles: from YAML or tables, checked, as small DataFrames."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.config import SECTIONS, TRAITS, SelectionRules
from presswerk.sources.store import read_yaml

SOURCE = "name string, url string, category string, enabled boolean, access_type string, source_access_tier string, rss_url string, api_url string, scrape_url string"
PROFILE = "profile_id string, profile_name string, description string, is_default boolean, priority_sections array<string>, interests array<string>, traits struct<" + ",".join(f"{t}:int" for t in TRAITS) + ">"
# Ways of access, and the tier that a source of each has unless it names one.
TIERS = {"rss": "rss_plus_extract", "api": "api_fulltext", "scrape": "rss_plus_extract", "rss_scrape": "rss_plus_extract"}
TIER_NAMES = ("rss_only", "rss_plus_extract", "api_fulltext", "blocked_or_paywalled")


def config_path(given: str | Path | None, variable: str, default: str | Path) -> Path:
    """What was asked for, else what the environment names, else the default."""
    return Path(given or os.environ.get(variable) or default)


def _filled(name: str) -> Column:
    return F.coalesce(F.trim(name) != "", F.lit(False))


def addresses() -> dict[str, Column]:
    """The address of a source for each way of reading it, null where it isn't read so."""
    kind = F.col("access_type")
    own = {"rss_url": ("rss", "rss_scrape"), "api_url": ("api",), "scrape_url": ("scrape",)}
    out = {name: F.when(kind.isin(*kinds), F.when(_filled(name), F.col(name)).when(_filled("url"), F.col("url"))) for name, kinds in own.items()}
    out["scrape_url"] = F.when(kind == "rss_scrape", F.when(_filled("scrape_url"), F.col("scrape_url"))).otherwise(out["scrape_url"])
    return out


def tier() -> Column:
    """A source's tier, by its way of access where it names none."""
    given = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.coalesce("source_access_tier", given[F.col("access_type")])


def faults() -> Column:
    """What is wrong with a source, as texts; an empty list is a good source."""
    found, kind = addresses(), F.col("access_type")

    def fault(wrong: Column, text: str) -> Column:
        return F.when(F.coalesce(wrong, F.lit(False)), F.lit(text))

    rules = [
        *[fault(~_filled(c), f"{c} is missing") for c in ("name", "url", "category")],
        fault(kind.isNull() | ~kind.isin(*TIERS), "access_type is unknown"),
        fault(~tier().isin(*TIER_NAMES), "source_access_tier is unknown"),
        *[fault(kind.isin(*kinds) & found[c].isNull(), f"{c} is needed") for c, kinds in (("rss_url", ("rss", "rss_scrape")), ("api_url", ("api",)), ("scrape_url", ("scrape", "rss_scrape")))],
        fault((tier() == "api_fulltext") & (kind != "api"), "api_fulltext is for interfaces"),
        fault((kind == "api") & tier().isin("rss_only", "rss_plus_extract"), "an interface is api_fulltext or blocked_or_paywalled"),
    ]
    return F.array_compact(F.array(*rules))


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, null where ``rows`` lack them."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def resolved_sources(rows: DataFrame) -> DataFrame:
    """Sources with defaults, tier and addresses; ``faults`` lists what is wrong with each."""
    full = shaped(rows, SOURCE).withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("access_type", F.coalesce("access_type", F.lit("rss")))
    return full.withColumns({"source_access_tier": tier(), **addresses(), "faults": faults()})


def checked(rows: DataFrame, name: str) -> DataFrame:
    """Rows without faults and that column; any fault is an error that names the first twenty."""
    bad = rows.where(F.size("faults") > 0).select(name, "faults").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r[0]}: {', '.join(r[1])}" for r in bad))
    return rows.drop("faults")


def _known(given: dict, allowed: set[str], what: str) -> dict:
    if over := sorted(set(given) - allowed):
        raise ValueError(f"{what} has unknown keys: {', '.join(over)}")
    return given


def load_sources(spark: SparkSession, path: str | Path | None = None, variable: str = "PRESSWERK_SOURCES", default: str = "config/sources.yaml") -> DataFrame:
    """The checked register from YAML (``sources``: a list of mappings)."""
    names = [x.split()[0] for x in SOURCE.split(", ")]
    held = read_yaml(config_path(path, variable, default)).get("sources") or []
    rows = [tuple(_known(s, {*names, "scrape_text_tags", "scrape_link_hint", "scrape_notes"}, "a source").get(n) for n in names) for s in held]
    return checked(resolved_sources(spark.createDataFrame(rows, SOURCE)), "name")


def profile_faults() -> Column:
    trait = [F.coalesce(~F.col(f"traits.{t}").between(1, 5), F.lit(True)) for t in TRAITS]
    rules = [
        *[F.when(~_filled(c), F.lit(f"{c} is missing")) for c in ("profile_id", "profile_name", "description")],
        F.when(F.coalesce(F.size("priority_sections") < 1, F.lit(True)), F.lit("priority_sections is empty")),
        F.when(F.exists("priority_sections", lambda s: ~s.isin(*SECTIONS)), F.lit("priority_sections has unknown sections")),
        F.when(reduce(lambda a, b: a | b, trait), F.lit("traits must be 1 to 5")),
        F.when(F.count("*").over(_same("profile_id")) > 1, F.lit("profile_id is not unique")),
    ]
    return F.array_compact(F.array(*rules))


def _same(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def load_profiles(spark: SparkSession, path: str | Path | None = None, variable: str = "PRESSWERK_PROFILES", default: str = "config/reader_profiles.yaml") -> DataFrame:
    """The checked profiles from YAML, with ``active`` on the one that ``active_profile`` names."""
    given = _known(read_yaml(config_path(path, variable, default)), {"active_profile", "profiles"}, "the file of profiles")
    names = PROFILE.split(" struct<")[0].split(", ")
    names = [n.split()[0] for n in names]
    rows = [tuple(tuple((p.get("traits") or {}).get(t) for t in TRAITS) if n == "traits" else p.get(n) for n in names) for p in given.get("profiles") or []]
    held = spark.createDataFrame(rows, PROFILE)
    out = checked(held.withColumn("faults", profile_faults()), "profile_id").withColumn("active", F.col("profile_id") == F.lit(given.get("active_profile")))
    if out.where("active").isEmpty():
        raise ValueError("active_profile must name one of the profiles")
    return out


def active_profile(profiles: DataFrame) -> DataFrame:
    """The one profile that is active, or the first by id of those marked as default."""
    mark = "active" if "active" in profiles.columns else "is_default"
    return profiles.where(F.coalesce(F.col(mark), F.lit(False))).orderBy("profile_id").limit(1)


def load_rules(path: str | Path | None = None, variable: str = "PRESSWERK_RULES", default: str = "config/synthesis.yaml") -> SelectionRules:
    """The rules of selection from YAML; keys of other steps are left to them, wrong values are errors."""
    given = read_yaml(config_path(path, variable, default))
    # The file's names for the rules.
    names = {
        "brief_min_items": "least_items", "brief_max_items": "most_items", "selection_core_allowed_cluster_qualities": "core_qualities", "selection_section_minimums": "section_minimums",
    }
    taken = {ours: given[theirs] for theirs, ours in names.items() if given.get(theirs) is not None}
    if "core_qualities" in taken:
        taken["core_qualities"] = tuple(taken["core_qualities"])
    return SelectionRules(**taken)
