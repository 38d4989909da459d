"""Families of queries; importing this registers them all."""

from . import evolving, features, joins, joint, market, models, payloads, regressions, research, rollups, staging, streams, tempo, testing, warehouse

__all__ = ["evolving", "features", "joins", "joint", "market", "models", "payloads", "regressions", "research", "rollups", "staging", "streams", "tempo", "testing", "warehouse"]
