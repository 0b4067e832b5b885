"""Query plans over the role views, and their registry."""
