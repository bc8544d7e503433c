"""Frame-to-frame steps. Those that write say so and take a Warehouse."""
