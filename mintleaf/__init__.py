"""mintleaf: review analytics and text-corpus operators as PySpark DataFrame functions."""
