"""winnow: table preparation and data-quality operators for Spark DataFrames.

Every operator takes a DataFrame (plus explicit key / order columns where row
identity matters) and returns a DataFrame.  Reports are tidy tables.
"""

__version__ = "0.1.0"
