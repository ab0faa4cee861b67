"""DataFrame to DataFrame operators.  Column names and policy constants are parameters."""
