"""Reconcile tables on Spark: keyed snapshot diffs, drift details, apply and export."""

import sys

from pyspark import cloudpickle

from reconcile import plan, sources
from reconcile.functions import keys, text
from reconcile.operators import definitions, drift, filters
from reconcile.plans import results
from reconcile.plans.definitions import plan_definitions, with_definition_details
from reconcile.sinks import apply, export

# The few Python functions that run in tasks travel with the job, so that this
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "apply",
    "definitions",
    "drift",
    "export",
    "filters",
    "keys",
    "plan",
    "plan_definitions",
    "results",
    "sources",
    "text",
    "with_definition_details",
]
