"""Query text to DataFrame: parsing, planning, policy, execution."""
