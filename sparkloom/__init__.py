"""Sparkloom: an analytics engine expressed in PySpark."""
