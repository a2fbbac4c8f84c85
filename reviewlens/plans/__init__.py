"""Whole jobs put together from the operators, and the driver-table inputs for them."""
