"""lamina: a PySpark-native engine that folds multi-site edit logs of feature collections.

The log of edits is a DataFrame; registers are arg-max aggregates, clocks are
gaps-and-islands queries, vertex order is a grouped walk, and everything else
is left to Catalyst. See README.md for the map of modules.
"""

__version__ = "0.1.0"
