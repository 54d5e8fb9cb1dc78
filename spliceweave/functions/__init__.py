"""Column functions: keys, genotype strings, distributions, vectors."""
