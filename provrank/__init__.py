"""Provenance-carrying graph retrieval and counterfactual testing on PySpark."""
