"""opsloom: operational-intelligence operators as plain PySpark DataFrame functions."""
