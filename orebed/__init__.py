"""orebed: Spark-native data mining (statistics, itemsets, similarity, ratings, graphs)."""
