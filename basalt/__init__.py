"""basalt: a relational, vector and corpus analytics engine declared on PySpark DataFrames."""

__version__ = "0.1.0"
