"""Reading exports and feeds, and loading them without double counting."""
