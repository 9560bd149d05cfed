"""Watchers, publishers and archives: what runs until it is stopped."""
