"""Composed plans: ETL pipelines, analogue tables and the registered queries."""
