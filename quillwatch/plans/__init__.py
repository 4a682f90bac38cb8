"""Whole jobs composed from operators: scan reports, store maintenance, exports."""
