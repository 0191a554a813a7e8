"""Column functions and the few vectorised Python helpers (Arrow-batched pandas UDFs)."""
