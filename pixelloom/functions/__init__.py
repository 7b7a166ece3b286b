"""Part of the screen-structure engine."""
