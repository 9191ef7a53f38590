"""postpulse: analytics on short social posts, by topic, on Apache Spark."""

__version__ = "0.1.0"
