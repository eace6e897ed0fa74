"""The queries users run, put together from the operators."""
