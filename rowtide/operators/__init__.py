"""Relational operators: polls, shard filters, change sets, gauges."""
