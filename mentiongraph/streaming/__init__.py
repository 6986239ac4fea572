"""Structured Streaming entry points over the batch operators (ST1-ST7)."""
