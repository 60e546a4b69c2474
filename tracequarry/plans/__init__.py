"""Helpers that shape plans: shared folders, cut lineage, worker set-up."""
