"""The expression language: parser, intervals, dates, and the registry of functions."""
