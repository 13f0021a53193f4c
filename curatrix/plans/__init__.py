"""Plans that operators share, and the queries over the test tables."""
