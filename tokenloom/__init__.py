"""tokenloom: corpus preparation, token packing and run analytics on Spark."""

__version__ = "0.1.0"
