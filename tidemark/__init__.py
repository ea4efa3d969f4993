"""Exchange-event analytics on PySpark: declarative plans that run unchanged on batch and streaming inputs."""
