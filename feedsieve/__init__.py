"""feedsieve: feed and document screening as Spark DataFrame operators."""
