"""findinglake: security-finding analytics expressed as Spark jobs.

Files, patches, manifests and scan history are Spark tables; rules are Column
predicates; lifecycle, ranking and trends are joins, aggregates and windows.
"""

__version__ = "0.1.0"
