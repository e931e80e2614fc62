"""Registered queries: each module maps names to Spark plans and to the oracle's SQL."""
