"""Physical building blocks: binned overlap joins, chunked running values, islands, sweeps and nearest neighbours."""
