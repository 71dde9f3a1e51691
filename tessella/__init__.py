"""Tessella: Spark-native sampling, evaluation and analytics operators."""

from tessella.session import session

__all__ = ["session"]
