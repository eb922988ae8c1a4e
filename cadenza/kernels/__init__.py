"""Order-dependent work on the rows of one song, take or user; a group is bounded by the length of a recording."""
