"""Closed vocabularies and fixed parameters of the knowledge model."""

from __future__ import annotations

# Fixed values.
LAYERS = ("memory", "knowledge", "wisdom", "intelligence")
NODE_STATES = ("ACTIVE", "SUPERSEDED", "TOMBSTONED", "DELETED")
ACYCLIC_EDGES = ("SUPERSEDES", "DERIVED_FROM", "SYNTHESIZED_FROM", "CAUSES")
SOURCE_TIERS = ("authoritative", "validated", "community", "unknown")
TIER_WEIGHT = {"authoritative": 1.0, "validated": 0.85, "community": 0.6, "unknown": 0.4}
TIER_RANK = {"authoritative": 3, "validated": 2, "community": 1, "unknown": 0}
METHOD_WEIGHT = {"direct": 1.0, "validated_extractor": 0.85, "standard_extractor": 0.75, "experimental": 0.6}
DECAY_MULTIPLIER = {"Claim": 1.0, "Finding": 1.0, "Fact": 2.0, "Commitment": 3.0, "Insight": 4.0, "ReasoningChain": 4.0}
DIFFUSION_WEIGHT = {
    "CONTRADICTS": 0.95, "SUPPORTS": 0.90, "DEPENDS_ON": 0.85, "CITES": 0.80, "CAUSES": 0.80,
    "DERIVES_FROM": 0.75, "CORROBORATES": 0.70, "PREVENTS": 0.70, "RELATED_TO": 0.40,
}
HALF_LIFE_DAYS = 7.0
#: The moment as of which queries over the given tables run.
AS_OF = "2024-02-01 00:00:00"
