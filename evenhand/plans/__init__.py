"""Registered queries: what runs on the given tables, each with the equivalent SQL where there is one."""
