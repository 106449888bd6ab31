"""cuadre operators."""
