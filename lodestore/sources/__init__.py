"""Where tables and vectors come from and go to."""
