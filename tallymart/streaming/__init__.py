from tallymart.streaming.ingest import Market, ingest_stream
from tallymart.streaming.windows import inflow

__all__ = ["Market", "inflow", "ingest_stream"]
