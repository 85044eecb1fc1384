"""Small pure functions: graphs, hashes, distance buckets, bitmaps."""
