"""Live ingest: a listening source and the streaming form of the batch plan."""
