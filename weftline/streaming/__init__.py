"""Plans and contracts over streams."""
