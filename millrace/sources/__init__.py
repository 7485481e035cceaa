"""Tables: fixture views, versioned storage, append logs."""
