"""Jobs that wire operators, and the registered queries with their SQL."""
