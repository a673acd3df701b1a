"""quire - document preparation on Spark.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers, writers, table-derived inputs), ``streaming``
(Structured Streaming jobs) and ``plans`` (registered queries and their SQL
twins).  See README.md.
"""

__version__ = "0.1.0"
