"""Where reports and models go."""
