"""Column builders: parsing, event types, features, residuals and guarded arithmetic."""
