"""Pure column functions: no joins, no shuffles, no Python UDFs."""
