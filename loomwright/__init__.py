"""loomwright: requirement/code consistency analytics and data quality operators on PySpark."""

__version__ = "0.1.0"
