"""cuadre streaming."""
