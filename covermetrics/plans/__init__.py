"""Named queries over a data folder, each with an equivalent SQL text where one exists."""
