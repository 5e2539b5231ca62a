"""Building elements, routes, floors, checks and packages on top of the generic operators."""
