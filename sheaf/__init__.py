"""Spark-first engine for harvested web text: extraction, scoring, classification, linking, graph and analytics."""
