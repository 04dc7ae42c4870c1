"""The registered queries: test tables in the shape of the sale data, plans and SQL."""
