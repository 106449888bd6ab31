"""cuadre sources."""
