"""Column builders: scalar functions kept inside generated code."""
