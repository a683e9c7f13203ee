"""Whole flows: the enrichment plan, derived inputs and the query catalog."""
