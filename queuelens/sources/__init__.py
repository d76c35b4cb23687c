from queuelens.sources.testdata import TestTables, load_tables
from queuelens.sources.csv_ingest import (read_fact_csv, read_inpatient_csv,
                                          read_mapping_csv, read_outpatient_csv)
from queuelens.sources.store import read_fact_store, write_fact_store

__all__ = ["TestTables", "load_tables", "read_fact_csv", "read_inpatient_csv",
           "read_outpatient_csv", "read_mapping_csv", "read_fact_store",
           "write_fact_store"]
