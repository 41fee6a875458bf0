"""Column functions; each returns a Column and is used inside the jobs of the other packages."""
