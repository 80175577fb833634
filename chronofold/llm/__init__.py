"""Training-data pipeline operators; each module states its contract in its docstring."""
