"""Rules of the news engine as frozen values; every operator takes the part it needs as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

SECTIONS = ("market", "general", "personal_interest")
QUALITIES = ("strong", "moderate", "weak")
TRAITS = ("calmness", "skepticism", "optimism", "urgency_sensitivity", "novelty_appetite", "macro_orientation", "market_focus", "contrarian_appetite", "personal_interest_weight", "signal_to_noise_strictness")


@dataclass(frozen=True)
class ClusterRules:
    """When two articles tell one story."""

    title_ratio: float = 0.9
    title_jaccard: float = 0.34
    shared_title_words: int = 2
    body_jaccard: float = 0.12
    shared_entities: int = 1
    loose_ratio: float = 0.72
    window_hours: int = 72
    most_links: int = 6
    most_text_chars: int = 4000


@dataclass(frozen=True)
class SelectionRules:
    """How many stories of which kind a brief takes."""

    least_items: int = 12
    most_items: int = 20
    publisher_cap: int = 2
    core_least_sources: int = 2
    core_qualities: tuple[str, ...] = ("moderate", "strong")
    section_minimums: dict[str, int] = field(default_factory=dict)
    allow_weak: bool = True

    def __post_init__(self) -> None:
        if self.least_items > self.most_items:
            raise ValueError("least_items must not exceed most_items")
        if not self.core_qualities:
            raise ValueError("core_qualities must not be empty")
        if any(n < 0 for n in self.section_minimums.values()):
            raise ValueError("section minimums must not be negative")

    def minimums(self) -> dict[str, int]:
        """The section minimums, cut to ``most_items`` from general, then market, then personal interest."""
        left = {s: self.section_minimums.get(s, 0) for s in SECTIONS}
        over = sum(left.values()) - self.most_items
        for section in ("general", "market", "personal_interest"):
            cut = min(max(over, 0), left[section])
            left[section] -= cut
            over -= cut
        return left


@dataclass(frozen=True)
class Vocabulary:
    """The words by which texts are assigned to sections."""

    market: tuple[str, ...] = (
        "market", "markets", "economy", "economic", "earnings", "revenue", "profit", "stocks", "equity", "bond", "bonds", "rates", "inflation", "gdp", "treasury",
        "federal reserve", "fed", "jobless", "unemployment", "oil", "commodities", "currency", "bank", "banking", "ipo", "merger", "acquisition",
    )
    high_signal: tuple[str, ...] = ("inflation", "cpi", "pce", "federal reserve", "rate cut", "rate hike", "yield", "treasury", "earnings", "guidance", "credit")
    macro: tuple[str, ...] = (
        "inflation", "cpi", "pce", "federal reserve", "rate cut", "rate hike", "yield", "treasury", "earnings", "guidance", "credit",
        "recession", "gdp", "debt", "default", "liquidity", "tariff", "sanctions",
    )
    other: tuple[str, ...] = (
        "lifestyle", "travel", "fashion", "celebrity", "sports", "golf", "entertainment", "shopping", "recipe", "tv", "movie", "podcast", "coupon", "deal",
        "baggage", "headphone", "contest", "rewards", "classifieds",
    )
    market_categories: tuple[str, ...] = ("business_markets",)
    personal_categories: tuple[str, ...] = ("golf",)
    blocked_categories: tuple[str, ...] = ("politics", "health_life", "sports", "golf", "local_az")
    excluded_titles: tuple[str, ...] = ("3 stocks", "stocks that", "should you buy", "price target", "monthly income", "dividend", "analyst says", "best stocks")
    personal_marks: tuple[str, ...] = ("golf", "pga", "witb", "what's in the bag")
    least_market: int = 2
    margin: int = 2
    least_high: int = 1
    least_macro: int = 2


# What each story tag is read from.
TAGS: dict[str, tuple[str, ...]] = {
    "economy": ("inflation", "rates", "federal reserve", "fed", "gdp", "unemployment", "jobs", "treasury"),
    "energy": ("oil", "gas", "energy", "opec", "pipeline"),
    "geopolitics": ("ukraine", "russia", "china", "taiwan", "israel", "gaza", "war", "sanctions"),
    "health": ("health", "hospital", "vaccine", "fda", "medical"),
    "markets": ("stocks", "equity", "bond", "bonds", "market", "earnings", "ipo", "acquisition", "merger"),
    "policy": ("congress", "white house", "senate", "house", "regulation", "tariff", "policy"),
    "sports": ("golf", "tournament", "pga", "masters", "score"),
    "technology": ("ai", "chip", "chips", "software", "cyber", "security", "cloud", "nvidia", "intel"),
}

# Weights and words of the reader score.
WEIGHTS = {"interest": 1.8, "market": 0.9, "macro": 0.8, "urgency": 0.7, "novelty": 0.6, "contrarian": 0.5, "confidence": 0.4, "positive": 0.25, "sensational": 0.35, "noise": 0.55}
SIGNALS: dict[str, tuple[str, ...]] = {
    "macro": ("rates", "inflation", "federal reserve", "fed", "policy", "treasury", "gdp", "geopolitics", "recession", "economy"),
    "urgency": ("breaking", "urgent", "immediate", "today", "now", "alert"),
    "novelty": ("new", "launch", "debut", "emerging", "first", "novel"),
    "contrarian": ("contrarian", "underpriced", "under-discussed", "second-order", "minority view"),
    "positive": ("gain", "upside", "improve", "growth", "rebound"),
    "sensational": ("shocking", "explosive", "panic", "chaos", "outrage"),
}
THEMES = {
    "inflation": "inflation", "cpi": "CPI", "pce": "PCE", "federal reserve": "Fed policy", "rate cut": "rate expectations", "rate hike": "rate expectations",
    "yield": "Treasury yields", "treasury": "Treasury yields", "earnings": "earnings", "guidance": "corporate guidance", "credit": "credit conditions",
}
