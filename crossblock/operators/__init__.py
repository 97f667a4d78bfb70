"""DataFrame-to-DataFrame operators: joins, ranks, aggregates, resampling, gates."""
