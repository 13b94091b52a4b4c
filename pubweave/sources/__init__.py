"""Where papers come from and where publications are kept."""
