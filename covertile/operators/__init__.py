"""DataFrame-in, DataFrame-out operators on intervals, depths, tiles, calls and reads."""
