"""Whole experiments, and the queries registered with the driver."""
