"""Which country a publication belongs to, by whom its countries come from, and where its record goes next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import nonblank, split_list


def decide(target: str, every: Column, first: Column, corresponding: Column) -> Column:
    """The decision on a record, from arrays of country names: of all authors, of the first and of the corresponding ones.

    Corresponding authors decide; a first author is a hint that a person has to look at; without the target country
    there is nothing to own. Null arrays count as empty.
    """
    none = F.array().cast("array<string>")
    every, first, corresponding = (F.coalesce(c, none) for c in (every, first, corresponding))
    at = F.lit(target)
    foreign = F.exists(every, lambda c: c != at)
    led, shared = F.size(corresponding) > 0, F.array_contains(corresponding, at)
    alone = shared & ~F.exists(corresponding, lambda c: c != at)

    def verdict(decision: str, kind, confidence, lead, waits: bool) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            F.lit(decision).alias("decision"), text(kind).alias("ownership_class"), text(confidence).alias("confidence"),
            F.array_join(F.array_sort(lead), "; ").alias("lead_country"), foreign.alias("has_foreign"), F.lit(waits).alias("needs_review"),
        )

    return (
        F.when(~F.array_contains(every, at), verdict("EXCLUDE", "NO_LK_PUBLICATION_AFFILIATION", F.when(F.size(every) > 0, "HIGH").otherwise("LOW"), every, False))
        .when(led & alone, verdict("INCLUDE", F.when(foreign, "SL_OWNED_INTERNATIONAL").otherwise("SL_DOMESTIC"), "MEDIUM", corresponding, False))
        .when(led & shared, verdict("REVIEW", "CONFLICTING_CORRESPONDING_LEADERSHIP", "LOW", corresponding, True))
        .when(led, verdict("EXCLUDE", "FOREIGN_PROJECT_WITH_SL_PARTICIPATION", "MEDIUM", corresponding, False))
        .when(F.array_contains(first, at), verdict("REVIEW", "FIRST_AUTHOR_ONLY_LK_EVIDENCE", "LOW", first, True))
        .otherwise(verdict("REVIEW", "MISSING_LEADERSHIP_EVIDENCE", "LOW", every, True))
    )


def verified(target: str, decision: Column, confidence: Column, needs_review: Column, lead: Column, version: Column, policy: str) -> Column:
    """Included with some confidence, not waiting, led by the target country, under the policy in force."""
    return F.coalesce((decision == "INCLUDE") & confidence.isin("HIGH", "MEDIUM") & ~needs_review & F.array_contains(split_list(lead), target) & (nonblank(version) == policy), F.lit(False))


def repository_only(source: Column, decision: Column, ownership_class: Column) -> Column:
    """Known from a repository alone, and still to be looked at."""
    return F.coalesce(F.array_contains(split_list(source), "repositories_combined") & (decision == "REVIEW") & (ownership_class == "REPOSITORY_ONLY_EVIDENCE"), F.lit(False))


def route(is_verified: Column, decision: Column) -> Column:
    """``verified``, ``excluded`` or ``review``; a record that is neither verified nor excluded is looked at."""
    return F.when(decision == "EXCLUDE", "excluded").when(is_verified, "verified").otherwise("review")
