"""Structured Streaming jobs: frozen scoring, per-key learning with state,
micro-batch global learning, running policy metrics."""
