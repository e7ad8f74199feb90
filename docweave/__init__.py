"""docweave: document-corpus preparation and retrieval on Spark.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column ->
Column``) function. Nothing passes whole through the driver; the heavy
work is expressed with the DataFrame API so Catalyst can prune, push
down and plan the shuffles.
"""

__version__ = "0.1.0"
