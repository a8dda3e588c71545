"""A Spark-native engine for declarative, whitelisted search over DataFrames."""
