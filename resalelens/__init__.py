"""Find resale deals in tables of captured auction pages and sold prices."""
