"""A time-series analytics engine whose expression language compiles to Spark plans."""
