"""speclake: spectral-image analytics as Spark DataFrame jobs."""
