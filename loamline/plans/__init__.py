"""Named queries with their reference SQL, and the guarded SQL entry."""
