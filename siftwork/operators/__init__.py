"""Mining operators over DataFrames: graphs, features, similarity, clusters, differences, queries, statistics, structure."""
