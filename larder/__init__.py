"""Larder: supply-chain analytics operators for Apache Spark."""

from larder.session import build_session

__all__ = ["build_session"]
