"""Functions: Column -> Column helpers shared by operators."""
