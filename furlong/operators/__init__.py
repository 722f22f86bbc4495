"""DataFrame operators that the jobs are composed of."""
