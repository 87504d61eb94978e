"""Code-intelligence analytics over file, symbol, graph and history tables, written as Spark plans.

The verbs are in ``quarryline.plans.verbs``, the index in ``quarryline.plans.index``, operators below
``quarryline.operators``.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
