"""Field-survey analytics as Spark DataFrame jobs.

Layers, lowest first:

``functions``   column expressions (missing-value rules, labels, classes, spherical area)
``operators``   DataFrame -> DataFrame steps that take column names
``sources``     tables in, layers and result pages out
``plans``       the user-level queries, composed from the layers below
"""

__version__ = "0.1.0"
