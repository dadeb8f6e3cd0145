"""Graph operators over DataFrames keyed by graph_id."""
