"""Where triples and entities come from, and where models go."""
