"""The functions of the expression language, by kind. Importing the package registers them."""

from seriesloom.operators import aggregate, elementwise, filters, grouping, naming, numeric, pairs, shifting, sorting, windows

__all__ = ["aggregate", "elementwise", "filters", "grouping", "naming", "numeric", "pairs", "shifting", "sorting", "windows"]
