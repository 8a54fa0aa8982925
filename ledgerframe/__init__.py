"""ledgerframe — a PySpark-native sales-BI analytics engine.

Layers (all lazy DataFrame plans; Catalyst/AQE choose the physical strategy):

* ``sources``   — readers for raw tables and the driver-table adapter;
* ``functions`` — T-SQL / DAX scalar semantics as built-in Column helpers;
* ``operators`` — reusable distributed building blocks (scalable global
  NTILE, skew-safe pair counting, one-row statistics joins);
* ``plans``     — cleaning datasets, golden record, reports, measures, pages;
"""

__version__ = "0.1.0"
