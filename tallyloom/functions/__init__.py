"""Part of tallyloom."""
