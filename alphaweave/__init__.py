"""Factor research and portfolio analytics as composable DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
