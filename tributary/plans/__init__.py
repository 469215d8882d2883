"""Documents, their plans and their runs."""
