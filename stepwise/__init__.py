"""Interaction-trajectory curation as Spark DataFrame transformations."""
