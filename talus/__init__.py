"""talus: terrain-change analytics as PySpark DataFrame functions."""
