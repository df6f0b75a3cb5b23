from tallymart.sources.tables import table

__all__ = ["table"]
