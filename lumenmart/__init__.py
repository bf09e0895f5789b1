"""Business metrics, star-schema planning, layered tables and corpus operators as Spark DataFrame jobs."""
