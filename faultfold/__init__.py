"""faultfold: log triage and incident analytics as ordinary Spark DataFrames."""

__version__ = "0.1.0"
