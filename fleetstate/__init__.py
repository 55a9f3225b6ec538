"""fleetstate: lifecycle and registry analytics for managed-service fleets on PySpark.

Subpackages: ``sources`` (inputs and strict ingest), ``functions`` (column expressions),
``operators`` (batch operators), ``streaming`` (keyed state, timers, rounds), ``plans`` (the
registered queries and their SQL oracles). ``model`` holds the lifecycle and its rule table.
"""

__version__ = "0.1.0"
