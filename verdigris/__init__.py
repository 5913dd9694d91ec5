"""verdigris: typed expression programs compiled to Spark columns."""

__version__ = "0.1.0"
