"""Point-in-time sports and order analytics as plain PySpark DataFrame functions."""
