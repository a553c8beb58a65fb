"""Reading, generating and writing tables."""
