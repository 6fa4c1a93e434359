"""Training-data pipeline operators (``llm``).

Nothing else in the library imports this subpackage.  Functions of its modules
are pickled by value, so that Python workers need not have the package on
their path; :func:`crowdtrust.llm.common.per_process` keeps what is costly to
build (tokenizers, automata) once per worker process all the same.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
