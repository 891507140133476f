"""Landed inputs: listing pages, document bodies, page texts, raw bytes."""
