"""Scans that turn files and relations into typed frames."""
