"""veilspark: private-text preparation and retrieval as Spark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` (usable with ``df.transform``)
built over ``Column -> Column`` cores in :mod:`veilspark.functions`.
"""

__version__ = "0.1.0"
