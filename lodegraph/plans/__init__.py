"""Driver-side plans: fixpoints over DataFrames, projections of tables into graphs."""
