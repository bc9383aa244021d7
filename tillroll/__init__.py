"""tillroll: retail sales and inventory analytics as Spark DataFrame jobs.

Modules:

* ``functions.clean``  - cleaning rules as Column expressions
* ``operators``        - sales questions, drill-downs, catalog / stock,
                         explorer views, table maintenance
* ``sources``          - raw file reads and loaders, versioned tables, exports
* ``streaming.chunks`` - chunked uploads as a Structured Streaming job
* ``plans``            - registered queries over the fixture views, with
                         DuckDB oracles
"""

__version__ = "0.1.0"
