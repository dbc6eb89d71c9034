"""DataFrame operators: embedded JSON, nested search, videos, comments, running figures."""
