"""Batch detection and covering of chosen text in OCR output, as DataFrame operations."""
