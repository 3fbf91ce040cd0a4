"""Tessella: phrase-pair analytics over parallel text, as DataFrame plans."""
