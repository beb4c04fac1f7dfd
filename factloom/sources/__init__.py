"""Feeds: registry, raw payloads to records, orbital elements."""
