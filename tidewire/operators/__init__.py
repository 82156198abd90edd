"""DataFrame-to-DataFrame operators, each over all tickers at once."""
