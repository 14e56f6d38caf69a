"""Column functions: lexicons, text normalisation and pair similarities."""
