"""Named datasets put together from the operators."""
