"""Registered queries, each with its SQL check where SQL can express it."""
