"""Part of kinsieve; see README.md."""
