"""spotweave: mapping a labelled count matrix onto a spatial one, as Spark plans.

Matrices are long DataFrames ``counts(obs_id, feature, x)`` without zero rows, so
every operator is a join, a group-by, a window or a narrow map that Spark can
partition; see README.md for the data model and the module map.
"""

__version__ = "0.1.0"
