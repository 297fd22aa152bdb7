"""Analytics over sparse categorical tables (entities x features) as Spark jobs."""

__version__ = "0.1.0"
