"""Transfer-ledger analytics expressed as Spark DataFrame programs.

Layout:

``functions``  column expressions and split scans (no data access)
``sources``    readers, record normalisers, constant tables, table writers
``operators``  DataFrame -> DataFrame building blocks
``plans``      whole queries over the fixture tables, with their SQL oracles
``streaming``  Structured Streaming twins of the incremental jobs
"""

__version__ = "0.1.0"
