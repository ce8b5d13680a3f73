"""Registered queries of the relational engine: each with the SQL text that states its result."""
