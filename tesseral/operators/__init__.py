"""DataFrame-in, DataFrame-out operators. Nothing here collects data rows to the driver."""
