"""Procure-to-pay analytics as DataFrame functions on Spark.

Every operator takes DataFrames and explicit parameters (the ``as_of`` time
included) and returns a lazy DataFrame; Catalyst plans it, nothing is collected.
"""

__version__ = "0.1.0"
