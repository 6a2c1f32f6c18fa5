"""Security and operations log analytics as Spark DataFrame jobs."""

from quernlog.session import configure, get_session

__all__ = ["configure", "get_session"]
