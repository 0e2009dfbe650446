"""threatloom: message-threat analytics and text-corpus preparation on Spark DataFrames."""
