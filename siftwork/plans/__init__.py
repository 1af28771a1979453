"""Settings, and tables in the shared folder."""
