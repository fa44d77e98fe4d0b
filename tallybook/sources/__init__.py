"""Statement files: profiles, header detection, scan and ingest."""
