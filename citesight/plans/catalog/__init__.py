"""Query catalogue, one module per operator family (imported for registration)."""
