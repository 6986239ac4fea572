"""Intermediate tables in the shared scratch folder, dropped once the next step no longer needs them."""

from ..session import FREE_SHUFFLES, Scratch, freed_shuffles  # noqa: F401  (re-exported for the operators)
