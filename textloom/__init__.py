"""Document analytics and retrieval as DataFrame transformations."""
