"""mentiongraph: entity mentions, sentiment and an evolving relationship graph on Spark DataFrames."""

__version__ = "0.1.0"
