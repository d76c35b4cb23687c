from queuelens.streaming.ingest import start_fact_ingest

__all__ = ["start_fact_ingest"]
