"""folioforge: document analytics and retrieval as DataFrame plans."""
