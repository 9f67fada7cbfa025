"""Tables of an archive: reading, optional columns, atomic publishing."""
