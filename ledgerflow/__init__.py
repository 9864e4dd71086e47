"""Spark-native processing of ledger events, transactions and checkpoints."""

__version__ = "0.1.0"
