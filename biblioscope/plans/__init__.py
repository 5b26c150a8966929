"""Plans: the named results (what a caller asks for) built from the operators."""
