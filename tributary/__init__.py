"""tributary: declarative data pipelines on PySpark."""
