"""Operators for preparing training text: scoring, deduplication, scanning, packing and formatting.

Nothing outside this package imports it. ``queries`` holds the registered
queries; every other module is one operator or a helper of several.
"""
