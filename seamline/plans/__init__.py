"""Jobs a user calls, composed of the operators."""
