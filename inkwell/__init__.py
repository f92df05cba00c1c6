"""inkwell: text-corpus analytics as PySpark DataFrame transformations."""
