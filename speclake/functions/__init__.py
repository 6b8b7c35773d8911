"""Functions over the band array of a pixel or spectrum."""
