"""Multi-layer network analytics and corpus preparation as Spark DataFrame programs."""
