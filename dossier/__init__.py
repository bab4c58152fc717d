"""Dossier: entity resolution and lead analytics on Spark."""
