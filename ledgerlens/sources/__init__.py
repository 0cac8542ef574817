"""Readers for OCR payloads and HTML tables, and the export sinks."""
