"""Quarterdeck: point-in-time panel analytics and data-quality operators on PySpark.

Operators are functions from DataFrame to DataFrame.  They read the columns
they are told to read, ignore every other column of their input, and leave the
physical strategy to Catalyst and AQE.
"""
