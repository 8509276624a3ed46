"""Survey-shaped views over the test tables, and the checked queries on them."""
