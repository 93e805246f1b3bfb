"""Driver-side models: small arrays of numbers that are sent to the executors."""
