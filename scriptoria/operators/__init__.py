"""DataFrame operators over corpora: normalise, segment, detect, aggregate, compare, review."""
