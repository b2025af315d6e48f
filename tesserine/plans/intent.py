"""Intent of a query text, its fusion strategy, and the bounds a search request must keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first intent with a keyword inside the lower-cased text wins.
KEYWORDS = (
    ("code", ("fn ", "rust", "stacktrace", "compile", "trait", "function")),
    ("causal", ("because", "caused", "why", "causal", "leads to")),
    ("entity", ("who", "entity", "person", "company", "organization")),
    ("temporal", ("when", "recent", "yesterday", "recurring", "periodic")),
    ("speaker", ("speaker", "voice", "said")),
    ("style", ("style", "tone", "register")),
    ("civic", ("polis", "vote", "civic", "policy")),
    ("media", ("image", "audio", "video", "media")),
    ("bridge", ("bridge", "connect", "between")),
    ("kernel", ("kernel", "grounding", "anchor")),
    ("lexical", ("exact", "keyword", "literal", "bm25")),
    ("multimodal", ("multimodal", "cross modal")),
    ("semantic", ("meaning", "semantic", "similar")),
)
MAX_K, MAX_EF, MAX_SLOTS, MAX_COST = 100, 512, 16, 20_000_000


def intent(text: Column) -> Column:
    """``general`` without a keyword; NULL text counts as empty."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("general")
    for label, words in reversed(KEYWORDS):
        out = F.when(low.rlike("|".join(words)), label).otherwise(out)
    return out


@dataclass(frozen=True)
class SearchPlan:
    intent: str
    strategy: str
    slots: tuple[int, ...]
    cost: int


def plan(text: str, slots: tuple[int, ...], k: int, index_size: int, ef: int = 64, strategy: str | None = None) -> SearchPlan:
    """Requests beyond a bound are refused, never clamped. A given strategy wins over the intent's."""
    if not (0 < k <= MAX_K and 0 < ef <= MAX_EF and len(slots) <= MAX_SLOTS):
        raise ValueError(f"k <= {MAX_K}, ef <= {MAX_EF}, slots <= {MAX_SLOTS}")
    cost = max(len(slots), 1) * ef * k * max(index_size, 1) // 100
    if cost > MAX_COST:
        raise ValueError(f"cost {cost} exceeds {MAX_COST}")
    low = text.lower()
    label = next((name for name, words in KEYWORDS if any(w in low for w in words)), "general")
    own = {"code": f"single:{slots[0] if slots else 8}", "general": "rrf"}.get(label, f"weighted_rrf:{label}")
    return SearchPlan(label, strategy or own, tuple(slots), cost)
