"""Where tables and positions come from."""
