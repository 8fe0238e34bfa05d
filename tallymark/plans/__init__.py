"""Reports: compositions of operators, and their text form."""
