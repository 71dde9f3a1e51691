"""Part of Tessella."""
