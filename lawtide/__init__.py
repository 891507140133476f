"""lawtide: document monitoring on PySpark.

Landed publication pages in; paragraphs, topic tags, model scores, new items,
reports and run metrics out. Every step is a function from DataFrames to a
DataFrame; :mod:`lawtide.plans.run` composes them.
"""

from lawtide.config import MonitorConfig

__all__ = ["MonitorConfig"]
