"""parley — conversation-export analytics on Spark.

Reads chat exports (nested JSON) or the driver test tables, flattens them into
normalised DataFrames, materialises per-message / per-conversation / per-code-block
stats, and answers a fixed catalogue of report questions as DataFrames.
"""

from parley.config import Config
from parley.session import get_spark

__all__ = ["Config", "get_spark"]
