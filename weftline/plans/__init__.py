"""The declarative plan: documents, validation and lowering to one DataFrame."""
