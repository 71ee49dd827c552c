"""Writers of decompositions."""
