"""DataFrame operators of the profiling flow."""
