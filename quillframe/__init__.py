"""Quillframe: corpus preparation as Spark jobs.

Every public function is ``DataFrame -> DataFrame`` or ``Column -> Column``.
"""

import sys

from pyspark import cloudpickle

# Python code that runs in tasks travels with the task, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
