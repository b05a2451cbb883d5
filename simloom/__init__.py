"""Content-code similarity engine expressed as PySpark DataFrame plans."""
