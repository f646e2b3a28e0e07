"""tillsight: retail-sales analytics as Spark DataFrame operators.

Every operator is a function ``f(df, *, params) -> DataFrame``; thresholds
are keyword arguments whose defaults are the values the original report
job used. No fact rows ever reach the driver: its only round-trips are
one-row results (the convergence checks of the two graph loops, the vertex
counts that decide whether a loop broadcasts, and scalar subqueries that
Spark evaluates and inlines).
"""

__version__ = "0.1.0"
