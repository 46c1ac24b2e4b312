"""Feature, validation, risk and tuning analytics for ordered series on Spark."""
