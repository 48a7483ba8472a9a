"""loamsift: corpus deduplication and training-data preparation on PySpark.

The package is pickled by value, so executors run its functions without the
package being installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
