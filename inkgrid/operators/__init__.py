"""DataFrame operators on rasters, tiles, sheets and jobs."""
