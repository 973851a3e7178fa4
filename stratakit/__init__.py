"""stratakit: user/item populations, stratified sampling, response scoring,
feature preparation, strata, fairness relabelling and queue-rule replay as
PySpark DataFrame operators.

Every operator is a function ``DataFrame(s) -> DataFrame`` that only builds a
lazy plan; Catalyst and AQE choose the physical strategy.
"""

__version__ = "0.1.0"
