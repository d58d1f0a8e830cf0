"""DataFrame to DataFrame operators; all of them stay lazy."""
