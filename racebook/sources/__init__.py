"""Readers, writers and the adapters over the benchmark tables."""
