"""Part of the tile analytics library."""
