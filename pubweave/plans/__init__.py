"""Composed runs: collection to store, store to report tables."""
