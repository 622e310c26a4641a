"""sumac: corpus analytics and answer auditing as Spark DataFrame jobs."""
