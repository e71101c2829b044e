"""Catalogue fusion on Spark: many noisy source records in, one item table out.

Layout
------
functions   column expressions (``Column -> Column``), all JVM side
operators   table jobs (``DataFrame -> DataFrame``): fusion, joins, linkage, reports
sources     readers and writers
plans       whole jobs made of operators, and skew helpers
streaming   Structured Streaming twins of the incremental jobs
workload    the registered queries run by the driver and by ``bench.py``
"""

__version__ = "0.1.0"
