"""Plans: the keyed snapshot diff and what is read off it."""
