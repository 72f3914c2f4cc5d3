"""DataFrame-in, DataFrame-out operators of the general core."""
