"""Pulse: world news sentiment analytics as PySpark DataFrame operators."""

from pulse.config import PulseConfig
from pulse.session import build_session

__all__ = ["PulseConfig", "build_session"]
