"""Market-shaped views over the generated star-schema tables, with their SQL twins."""
