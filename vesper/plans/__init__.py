"""Compositions: features, entry modes, and the catalog of registered queries."""
