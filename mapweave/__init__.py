"""A map-data engine on DataFrames: storing, tiling, updating and querying nodes, ways, relations and what derives from them."""
