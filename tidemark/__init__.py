"""tidemark: a PySpark-native engine for time-split classification studies.

Every operator takes DataFrames and parameters and returns a DataFrame; see README.md.
"""

import sys

from pyspark import cloudpickle

# Workers need no installed copy: functions sent to them take their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
