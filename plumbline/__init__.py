"""plumbline: table audit, drift, feature and model operators as Spark DataFrame functions."""

from plumbline.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
