"""Column expressions and UDF variants shared by the operators."""
