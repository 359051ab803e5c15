"""The library has no streaming operators: every figure is a batch aggregate over finished runs."""
