"""Text indexing, retrieval and corpus analytics as DataFrame programs."""
