"""A keyed-table and matrix-table analytics engine written on PySpark."""
