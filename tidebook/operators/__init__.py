"""DataFrame operators. Every function takes and returns DataFrames and declares its plan lazily."""
