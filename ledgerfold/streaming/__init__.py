"""The operation log as a stream."""
