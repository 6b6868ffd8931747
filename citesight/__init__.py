"""citesight: scholarly-corpus analytics as plain Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (built for
``df.transform``); nothing passes whole through the driver.
"""

__version__ = "0.1.0"
