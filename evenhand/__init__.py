"""evenhand: fair comparisons and cited evidence as Spark jobs.

Operators take DataFrames and return DataFrames. See README.md for the layout.
"""

__version__ = "0.1.0"
