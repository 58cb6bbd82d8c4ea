"""Helpers that cut or stage plans."""
