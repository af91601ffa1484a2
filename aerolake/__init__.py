"""aerolake: analytics over fleets of vehicle flight logs, written on Spark DataFrames."""

__version__ = "0.1.0"
