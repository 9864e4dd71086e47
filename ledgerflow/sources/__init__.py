"""Readers for events, transactions and checkpoints."""
