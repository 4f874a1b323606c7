"""trafficbrick -- network traffic summarisation on Spark DataFrames."""

from .session import get_session  # noqa: F401

__version__ = "0.1.0"
