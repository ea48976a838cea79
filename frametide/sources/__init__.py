"""Sources: driver tables as frame streams, profiles, price and cache tables, synthetic paths, raw frames."""
