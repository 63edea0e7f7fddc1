"""regula: drug-approval analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames plus column names / constants and returns a
lazy DataFrame.  Nothing is collected except documented one-row statistics.
"""

__version__ = "0.1.0"
