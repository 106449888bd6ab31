"""cuadre: ledger harmonisation and journal analytics on Spark.

Every public function takes and returns DataFrames or Columns. Sub-packages:

* ``sources``   - scans of ledgers, text lines, driver tables and the seed catalogue; sinks.
* ``functions`` - Column builders (number / date / text cleaning, line features, validator scores).
* ``operators`` - DataFrame -> DataFrame operators (balance, journal, profiles, mapping, lines, ML).
* ``plans``     - composite batch jobs and the named queries registered in ``__spark_entry__``.
* ``streaming`` - the same journal checks driven by a file stream.
"""

__version__ = "0.1.0"
