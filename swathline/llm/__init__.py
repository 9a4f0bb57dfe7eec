"""Operators for building training corpora: joins, archives, tokens, packing, sharding and filters over document tables."""
