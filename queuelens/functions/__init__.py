from queuelens.functions.constants import (LONG_WAIT_BAND, PATIENT_TYPES,
                                           TIME_BANDS, DEFAULT_GROUP)
from queuelens.functions.options import Options
from queuelens.functions import measures

__all__ = ["LONG_WAIT_BAND", "PATIENT_TYPES", "TIME_BANDS", "DEFAULT_GROUP",
           "Options", "measures"]
