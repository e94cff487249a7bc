"""DataFrame operators; inputs and outputs are DataFrames."""
