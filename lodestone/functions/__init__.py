"""Column builders: tokenisers, vector maths, identity keys."""
