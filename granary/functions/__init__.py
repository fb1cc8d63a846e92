"""Column -> Column helpers and the fixed values they use."""
