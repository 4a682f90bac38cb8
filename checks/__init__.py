"""Inputs derived from the test tables, and the query / SQL pairs checked on them."""
