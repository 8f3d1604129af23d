"""File listings, the keyed catalog table and the stored text index."""
