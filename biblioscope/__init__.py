"""biblioscope: bibliometric analytics expressed as Spark DataFrame plans.

Three input tables (articles, journals, author/lab affiliations) are loaded,
cleaned once, and every analytic is a pure function from DataFrames to a
DataFrame.  Nothing is collected; callers decide how to write or show results.
"""

from biblioscope.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
