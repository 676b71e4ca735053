"""Search drivers, and the registered queries with their SQL."""
