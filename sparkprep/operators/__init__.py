"""DataFrame to DataFrame operators; every one can be used with ``df.transform``."""
