"""cardmill: contact-memory analytics as PySpark DataFrame jobs."""
