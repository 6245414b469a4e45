"""Label expressions: sentiment bands, category aliases, case types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import _col

# Normalised spellings of the four categories.
CATEGORY_ALIASES = {
    "electronics": "Electronics",
    "homeandkitchen": "Home_and_Kitchen",
    "homekitchen": "Home_and_Kitchen",
    "beauty": "Beauty_and_Personal_Care",
    "beautyandpersonalcare": "Beauty_and_Personal_Care",
    "sports": "Sports_and_Outdoors",
    "sportsandoutdoors": "Sports_and_Outdoors",
}


def sentiment(rating: Column | str) -> Column:
    """At most 2 is negative, 3 is neutral, the rest (also 2.5 and missing) positive."""
    r = _col(rating)
    return F.when(r <= 2, "negative").when(r == 3, "neutral").otherwise("positive")


def normalize_label(c: Column | str) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(_col(c).cast("string")), r"[^\p{L}\p{N}]", "")


def canonical_category(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Known spellings map to the canonical name, others stay as they are."""
    pairs = chain.from_iterable((aliases or CATEGORY_ALIASES).items())
    lookup = F.create_map(*[F.lit(x) for x in pairs])
    return F.coalesce(F.try_element_at(lookup, normalize_label(c)), _col(c).cast("string"))


def canonical_names(names, aliases: dict[str, str] | None = None) -> list[str]:
    """The same mapping for a short driver-side list of configured names."""
    table = aliases or CATEGORY_ALIASES
    return [table.get("".join(ch for ch in str(n).lower() if ch.isalnum()), str(n)) for n in names]


def case_type(top1_match: Column | str, matches: Column | str, success_at: int = 3) -> Column:
    """success: first neighbour and several more match; failure: none matches; else mixed."""
    top1, n = _col(top1_match), _col(matches)
    return (
        F.when(top1 & (n >= success_at), "success").when(n == 0, "failure").otherwise("mixed")
    )
