"""Column builders and distributed statistics shared by the operators."""
