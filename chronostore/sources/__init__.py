"""Where logs, chains and snapshots are read from and written to."""
