"""sieveline: message-risk analytics and corpus preparation as lazy Spark DataFrame pipelines."""

__version__ = "0.1.0"
