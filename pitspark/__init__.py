"""Point-in-time time-series analytics as PySpark DataFrame operators."""

from pitspark.session import build_session, prepare

__all__ = ["build_session", "prepare"]
