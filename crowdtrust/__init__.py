"""crowdtrust: crowd-preference truth inference and preference scoring on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a small
driver loop of such functions for the iterative EM fits).  Sub-packages:

* ``sources``   – readers/writers and the fixture tables derived from testdata
* ``functions`` – reusable Column expressions (hashing, stable sigmoid, ...)
* ``operators`` – votes preparation, EM steps/fits, baselines, preference
                  algebra, text features, models, metrics, robustness
* ``plans``     – multi-step jobs (standalone EM run, joint loop, sweep)
* ``streaming`` – Structured Streaming trust scoring and agreement
"""

__version__ = "0.1.0"
