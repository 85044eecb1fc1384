"""SQL text to conjunctive queries and their fragments."""
