"""Structured Streaming jobs over job events, corrections and OCR payloads."""
