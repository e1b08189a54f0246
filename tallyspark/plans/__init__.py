"""Plans that several operators share: the arenas, shared column rules and the season build."""
