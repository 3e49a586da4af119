"""Column expressions without any shuffle of their own."""
