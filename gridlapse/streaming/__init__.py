"""Window rollups over streams of trace rows."""
