"""queuelens: waiting-list snapshot analytics as lazy Spark plans.

Layers:
  sources    read and clean the yearly fact files, the specialty mapping and
             the synthetic test tables; write the partitioned fact store
  functions  column expressions shared by every report (rounding, ratios,
             band order, thresholds, number formatting)
  operators  reusable DataFrame operators (canonical model, densify, top-k,
             exact distribution statistics, rank tests, contingency tests)
  plans      the named reports, chart panels and the dashboard document
  streaming  incremental ingest of newly arriving yearly files
"""

from queuelens.functions.options import Options

__all__ = ["Options"]
__version__ = "0.1.0"
