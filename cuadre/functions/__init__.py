"""cuadre functions."""
