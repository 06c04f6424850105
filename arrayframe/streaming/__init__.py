"""Streams of steps: queue policies on step metadata, and Structured Streaming over stores."""
