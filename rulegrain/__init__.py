"""Rules, evidence and eligibility over DataFrames.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here runs an action unless its docstring says so.
"""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the plan, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
