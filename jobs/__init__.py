"""Jobs that run from a command line; `queries` registers them."""
